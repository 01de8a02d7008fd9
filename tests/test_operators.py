"""Unit tests of operators whose results are known by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ionloom.functions import columns as C
from ionloom.operators import fdr, joins, ordered, signal
from ionloom.operators.aggregate import Channel, GroupFilter, filtered
from ionloom.operators.inference import infer_groups
from ionloom.plans import tools
from ionloom.sources import tables


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_digest(spark):
    got = one(spark, C.digest(F.lit("AKRPCKD"), "trypsin", 1))
    assert sorted((r["peptide"], r["start"], r["missed"]) for r in got) == [("AK", 0, 0), ("AKRPCK", 0, 1), ("D", 6, 0), ("RPCK", 2, 0), ("RPCKD", 2, 1)]
    assert one(spark, C.digest(F.lit(""), "trypsin")) == []


def test_array_statistics(spark):
    a, b = F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(*map(F.lit, (2.0, 4.0, 7.0)))
    assert one(spark, C.pearson(a, b)) == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    assert one(spark, C.dot(a, b)) == 31
    assert one(spark, C.z_scores(a)) == [-1.0, 0.0, 1.0]


def test_topx_keeps_ties_and_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 3.0), ("b", None), ("b", 2.0)], "k string, v double")
    got = filtered(df, Channel("v", group_filters=(GroupFilter("topx", 1),)), ["k"], "o").where("o is not null")
    assert sorted((r.k, r.o) for r in got.collect()) == [("a", 3.0), ("a", 3.0), ("b", 2.0)]


def test_range_join_has_no_nested_loop(spark):
    a = spark.range(50).select(F.col("id").alias("i"), (F.col("id") * 1.5).alias("m"))
    b = spark.range(80).select(F.col("id").alias("j"), F.col("id").cast("double").alias("v"))
    got = joins.range_join(a, b, F.col("m") - 2, F.col("m") + 2, F.col("v"), 4.0)
    assert {(r.i, r.j) for r in got.collect()} == {(i, j) for i in range(50) for j in range(80) if abs(i * 1.5 - j) <= 2}
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_nearest_prefers_smaller_id_on_ties(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 0.0)], "i long, t double").withColumn("k", F.lit(1))
    b = spark.createDataFrame([(7, 8.0), (5, 12.0), (9, 12.0), (4, 30.0)], "j long, t double").withColumn("k", F.lit(1))
    got = joins.nearest(a, b, ["k"], "t", "i", "j")
    assert sorted((r.i, r.nearest_j, r.distance) for r in got.collect()) == [(1, 5, 2.0), (2, 7, 8.0)]


def test_storey_is_monotone(spark):
    df = spark.createDataFrame([(5.0, False), (4.0, True), (3.0, False), (2.0, False), (1.0, True)], "s double, d boolean")
    got = {r.s: r.q_value for r in fdr.storey_q(df, "s", F.col("d")).collect()}
    assert got == {5.0: 0.0, 4.0: pytest.approx(1 / 3), 3.0: pytest.approx(1 / 3), 2.0: pytest.approx(1 / 3), 1.0: pytest.approx(2 / 3)}


def test_hypergeometric_expectation():
    assert fdr.hypergeometric_expectation(0, 3, 10) == 0
    assert 0 < fdr.hypergeometric_expectation(5, 2, 20) <= 2


def test_group_when_and_chunks(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(7)], "i int, s boolean").withColumn("k", F.lit(0))
    assert [r.g for r in ordered.group_when(df, ["k"], "i", F.col("s"), "g").orderBy("i").collect()] == [1, 1, 1, 2, 2, 2, 3]
    assert [r.c for r in ordered.equal_chunks(df, ["k"], [F.col("i")], 3, "c").orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_signal():
    x = np.arange(20.0)
    assert np.allclose(signal.smoothing_spline(x, 2 * x + 1, 5.0, np.array([-3.0, 4.5, 30.0])), [-5, 10, 61])
    assert signal.dtw_distance(np.array([1.0, 2, 3]), np.array([1.0, 1, 2, 3])) == 0
    assert np.allclose(signal.savitzky_golay(x**2, 5)[3:-3], (x**2)[3:-3])
    top, mean, sd, area = signal.gaussian_area(x, 10 * np.exp(-((x - 9) ** 2) / 8))
    assert (top, mean, sd) == (pytest.approx(10), pytest.approx(9), pytest.approx(2)) and area == pytest.approx(10 * 2 * np.sqrt(2 * np.pi))


def test_inference_covers_all_peptides(spark):
    pairs = spark.createDataFrame([("p1", "A"), ("p2", "A"), ("p2", "B"), ("p3", "C"), ("p3", "D")], "peptide string, protein string")
    assert sorted((r.protein_group, r.peptides) for r in infer_groups(pairs).collect()) == [("A", 2), ("C;D", 1)]


def test_table_round_trip(spark, tmp_path):
    schema = StructType([StructField("s", StringType()), StructField("x", DoubleType()), StructField("n", IntegerType()), StructField("a", ArrayType(DoubleType())), StructField("new", DoubleType())])
    path = tmp_path / "in.tsv"
    path.write_text('s\tx\tn\ta\n"P"\tNaN\t3\t[|1;2.5|]\nQ\t1.5\t\t\n')
    df = tables.read_table(spark, str(path), schema)
    rows = sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])
    assert rows == [("P", None, 3, [1.0, 2.5], None), ("Q", 1.5, None, [], None)]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(path), schema, fill=False)
    tables.write_table(df, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "out"), schema).select("s", "x", "a").collect())) == [(r[0], r[1], r[3]) for r in rows]


def test_params():
    assert tables.plain_params({"A": {"Case": "Some", "Fields": [{"Case": "TopX", "Fields": [3]}]}, "B": {"Case": "Median"}}) == {"A": ("TopX", 3), "B": "Median"}


def test_label_free_levels(spark):
    cols = "FileName string, ProteinGroup string, ProteinGroup_QValue double, StringSequence string, PepSequenceID int, ModSequenceID int, Charge int, GlobalMod int, Quant_Light double, Quant_Heavy double, Correlation_Light_Heavy double"
    rows = [("f", "P", 0.01, "AA", 1, 1, 2, 0, 10.0, 5.0, 0.9), ("f", "P", 0.01, "AA", 1, 1, 3, 0, 20.0, 5.0, 0.9), ("f", "P", 0.01, "CC", 2, 2, 2, 0, 40.0, 8.0, 0.8), ("f", "P", 0.01, "DD", 3, 3, 2, 1, 99.0, 3.0, 0.1)]
    df = spark.createDataFrame(rows, cols)
    plain = tools.label_free(df).first()
    assert (plain.Quant_Light, plain.ItemsUsedForQuant_Light) == (pytest.approx(70 / 3), 3)
    charged = tools.label_free(df, tools.Quantification(charge=tools.plain(tools.LIGHT))).first()
    assert (charged.Quant_Light, charged.ItemsUsedForQuant_Light) == (27.5, 2)
    ratio = tools.labeled(df, tools.Quantification(min_correlation=0.5)).first()
    assert ratio.ItemsUsedForQuant_LightByHeavy == 3 and ratio.Ratio_LightByHeavy == pytest.approx((2 + 4 + 5) / 3)


def test_deduced_peptides(spark):
    prot = spark.createDataFrame([("P", "AA;CC", "C1a", 1.0, 0.0, 0.0), ("P", "CC;DD", "C1a", 1.0, 0.0, 0.0)], "ProteinGroup string, PeptideSequence string, Class string, TargetScore double, DecoyScore double, QValue double")
    quant = spark.createDataFrame([("f", "CC"), ("f", "CC"), ("g", "AA"), ("g", "DD")], "FileName string, StringSequence string")
    got = {(r.FileName, r.ProteinGroup, frozenset(r.PeptideSequence.split(";"))) for r in tools.add_deduced_peptides(prot, quant).collect()}
    assert got == {("f", "P", frozenset({"CC"})), ("g", "P", frozenset({"AA", "DD"}))}


def test_align_runs_searches_to_200(spark):
    x = np.arange(60.0)
    y = np.random.default_rng(3).normal(0, 1, 60) + x
    got = signal.align_runs(spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y, strict=True)], "k string, x double, y double"), "k", "k string, lambda double, r2 double, points int").first()
    test = np.arange(60) % 5 == 2
    assert (got["lambda"], got.r2) == signal.best_spline(x[~test], y[~test], x[test], y[test], range(1, 201)) and got["lambda"] > 40


def test_medians_are_exact_and_hold_no_group(spark):
    """No plan has Spark's percentile, whose buffer holds all distinct values of a group."""
    import statistics

    from ionloom.operators import aggregate as A
    from ionloom.operators import frames

    r = random.Random(4)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), r.choice([None, float(r.randint(0, 40))]), r.random()) for _ in range(500)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {x.k: x for x in A.grouped_values(df, ["k"], {"m": ("median", "v"), "s": ("sum", "v"), "mw": ("median", "w")}, [F.count("*").alias("n")]).collect()}
    for k in {k for k, _, _ in rows}:
        own = [v for i, v, _ in rows if i == k and v is not None]
        assert got[k].m == (statistics.median(own) if own else None) and got[k].mw == pytest.approx(statistics.median([w for i, _, w in rows if i == k]))
        assert got[k].n == sum(i == k for i, _, _ in rows) and got[k].s == (sum(own) if own else None)
    assert A.grouped_values(df, [], {"m": ("median", "w")}).first().m == pytest.approx(statistics.median([w for *_, w in rows]))
    plans = [A.tukey_aggregate(df, ["k"], "w", 1.5, "identity", "median", "o"), A.histogram(df, "w", 0.1, F.lit(False)), A.kernel_bandwidth(df, ["k"], "w", "b"), frames.apply_level(df, ["k"], ["w"], "median", "sum", []), A.aggregate(df, ["k"], {"w": A.Channel("w", agg="median")})]
    assert not [p for p in plans if "percentile" in p._jdf.queryExecution().toString().lower() or "median" in p._jdf.queryExecution().executedPlan().toString().lower().replace("median_score", "")]


def test_q_values_of_a_common_score(spark):
    """Half of all rows have one score; each gets its value, also beside missing scores."""
    from ionloom.operators.fdr import q_between

    knots = spark.createDataFrame([(0.0, 1.0), (1.0, 0.5), (2.0, 0.0)], "s double, q_value double")
    rows = spark.createDataFrame([(i, 0.5 if i % 2 else i / 100) for i in range(300)] + [(300, None), (301, -1.0), (302, 9.0)], "i int, s double")
    got = {r.i: r.q_value for r in q_between(knots, rows, "s").collect()}
    assert len(got) == 303 and all(got[i] == pytest.approx(0.75) for i in range(1, 300, 2)) and got[301] == 1.0 and got[302] == 0.0
    assert all(got[i] == pytest.approx(1 - i / 200 if i <= 200 else 0.0) for i in range(0, 300, 2))
    line = {r.i: r.q_value for r in q_between(knots, rows, "s", outside="linear").collect()}
    assert line[301] == pytest.approx(1.5) and line[302] == pytest.approx(-3.5) and line[4] == got[4]
