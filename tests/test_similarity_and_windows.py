"""Similarity search, spectra clustered by time and rows that fail, against plain loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ionloom.operators import similarity
from ionloom.operators.tolerant import tolerant
from ionloom.sources import clustered


def _bins(seed, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        own = {r.randrange(12) for _ in range(r.randint(1, 6))} | ({99} if r.random() < 0.8 else set())  # 99 is in most vectors
        rows += [(i, b, float(r.randint(1, 5))) for b in own]
    return [*rows, (3, 5, 2.0), (4, 1, None), (5, 2, float("nan")), (None, 3, 1.0), (n, 0, 0.0)]


def _unit(rows):
    v = {}
    for i, b, w in rows:
        if i is not None and w is not None and w == w:
            v.setdefault(i, {}).setdefault(b, 0.0)
            v[i][b] += w
    v = {i: {b: w for b, w in x.items() if w} for i, x in v.items()}
    return {i: {b: w / math.sqrt(sum(a * a for a in x.values())) for b, w in x.items()} for i, x in v.items() if x}


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.9, 1.0])
@pytest.mark.parametrize("seed", [1, 2])
def test_no_pair_above_the_threshold_is_lost(spark, threshold, seed):
    rows = _bins(seed)
    df = spark.createDataFrame(rows, "id int, bin int, w double").withColumn("extra", F.lit(1))
    got = {(r.query_id, r.id): r.cosine for r in similarity.similar(df, F.col("id") % 5 == 0, threshold).collect()}
    u = _unit(rows)
    every = {(i, j): sum(w * u[j].get(b, 0.0) for b, w in u[i].items()) for i in u if i % 5 == 0 for j in u if i != j}
    want = {k: c for k, c in every.items() if c >= threshold - 1e-9}
    assert got.keys() == want.keys() and got == pytest.approx(want)


def test_prefixes_leave_the_frequent_bins_out(spark):
    """Vectors with a heavy bin of their own and a light one that all share: nothing meets in the index, and no pair is near."""
    df = spark.range(500).select(F.col("id"), F.explode(F.array(F.struct(F.col("id").alias("bin"), F.lit(10.0).alias("w")), F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(1.0).alias("w")))).alias("x")).select("id", "x.*")
    index = similarity.prefixes(similarity.unit_vectors(df, "id", "bin", "w"), 0.5)
    assert index.count() == 500 and index.where("bin = -1").count() == 0
    assert similarity.similar(df, F.col("id") % 50 == 0, 0.5).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        similarity.similar(df, F.col("id") % 50 == 0, 0.0)
    assert similarity.similar(df.limit(0), F.col("id") % 50 == 0, 0.5).count() == 0


@pytest.fixture(scope="module")
def spectra(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered"))
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("run"), F.col("id").cast("string").alias("id"), (F.col("id") / 40.0).alias("rt"))
    clustered.write_clustered(df.unionByName(spark.createDataFrame([("a", "none", None)], "run string, id string, rt double")), path, 16)
    return path


def _files_read(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_the_manifest_bounds_each_file(spark, spectra):
    rows = clustered.manifest(spark, spectra).collect()
    assert sum(r.spectra for r in rows) == 4001 and len({r.file for r in rows}) >= 12
    for run in "ab":
        own = sorted((r.low, r.high) for r in rows if r.run == run and r.low is not None)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))


def test_a_window_reads_the_files_of_its_minutes(spark, spectra):
    window = clustered.read_window(spark, spectra, "a", 40.0, 41.0)
    assert _files_read(window) <= 2
    assert {r.id for r in window.collect()} == {str(i) for i in range(1600, 1641) if i % 3}
    assert clustered.read_window(spark, spectra, "a", 1e6, 2e6).count() == 0 and clustered.read_window(spark, spectra, "zz", 0.0, 9.0).count() == 0
    assert clustered.read_window(spark, spectra, "a", -1.0, 1e6).count() == sum(1 for i in range(4000) if i % 3)


def test_many_windows_meet_their_spectra(spark, spectra):
    r = random.Random(2)
    wins = [(k, r.choice("ab"), a := r.uniform(0, 20), a + r.uniform(0, 2)) for k in range(40)] + [(40, "a", 5.0, 4.0), (41, None, 1.0, 2.0)]
    df = spark.createDataFrame(wins, "k int, run string, low double, high double")
    got = sorted((x.k, x.id) for x in clustered.read_windows(spark, spectra, df, 1.0).collect())
    want = sorted((k, str(i)) for k, run, low, high in wins for i in range(4000) if run == ("b" if i % 3 == 0 else "a") and low <= i / 40 <= high)
    assert got == want
    assert clustered.read_windows(spark, spectra, df.where("k = 40"), 1.0).count() == 0


def _root(row):
    if row.x is None:
        return None
    if row.x == 7:
        raise RuntimeError("seven " * 200)
    return [{"id": row.id, "root": math.sqrt(row.x)}] * (2 if row.x == 4 else 1)


def test_failing_rows_go_to_the_second_frame(spark):
    rows = [(1, 4.0), (2, -1.0), (3, 9.0), (4, 7.0), (None, -4.0), (6, float("nan")), (2**60 + 1, -9.0)]
    df = spark.createDataFrame(rows, "id long, x double").withColumns({"ok": F.lit(1), "kind": F.lit(2), "out": F.lit(3)})
    first = tolerant(df).map("root", ["id"], _root, "id bigint, root double")
    out = first.check("small", ["id"], F.col("root") < 3, F.concat(F.lit("root "), F.col("root")))
    good = first.good.collect()
    assert sorted((r.id, r.root) for r in good if r.root == r.root) == [(1, 2.0), (1, 2.0), (3, 3.0)] and [r.id for r in good if r.root != r.root] == [6]
    bad = {(r.id, r.stage, r.kind): r.message for r in out.bad.collect()}
    assert {k for k in bad if k[1] == "root"} == {(2, "root", "ValueError"), (4, "root", "RuntimeError"), (None, "root", "ValueError"), (2**60 + 1, "root", "ValueError")}
    assert len(bad[4, "root", "RuntimeError"]) == 500 and bad[3, "small", "Check"] == "root 3.0"
    assert out.counts == {"root": (4, 4), "small": (2, 2)}  # NaN is not below 3
    assert [r.id for r in out.good.collect()].count(1) == 2
    nothing = tolerant(df.limit(0)).map("root", ["id"], _root, "id bigint, root double")
    assert nothing.good.count() == 0 and nothing.bad.count() == 0 and nothing.counts["root"] == (0, 0)
    with pytest.raises(ValueError, match="no such columns"):
        tolerant(df).map("root", ["nope"], _root, "id bigint, root double")


def test_a_function_runs_once_for_each_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def f(row):
        seen.add(1)
        if row.id % 2:
            raise ValueError("odd")
        return {"id": row.id}

    out = tolerant(spark.range(50)).map("even", ["id"], f, "id bigint")
    assert (out.good.count(), out.bad.count(), seen.value) == (25, 25, 50)


def test_pairs_are_multiplied_where_they_meet(spark):
    # Negative weights too: a first common product above the threshold, a whole one below.
    rows = [(0, 1, 3.0), (0, 2, 1.0), (1, 1, 3.0), (1, 2, -2.0), (2, 1, 3.0), (2, 2, 1.0), (3, 3, 1.0)]
    df = similarity.similar(spark.createDataFrame(rows, "id long, bin long, w double"), F.col("id") % 2 == 0, 0.7)
    assert {(r.query_id, r.id) for r in df.collect()} == {(0, 2), (2, 0)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"\(bin#\d+L? = bin#", plan) and not re.search(r"\(query_id#\d+L? = query_id#", plan)
