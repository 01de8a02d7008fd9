"""Top-k, near-dedup, shards, mixing and the pipeline against brute force."""

import collections
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionloom.llm import darts, dedup, mixing, shards, topk


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (60, 4)) / 4.0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (63, [float("inf")] * 4), (64, [1.0] * 3), (65, [1.0] * 3), (66, []), (7, v[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(0))
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, 10, 4, 8).collect())
    want = collections.Counter()
    good = [(i, [int(np.floor(1024 * x)) for x in e]) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    for q, e in good:
        if q % 5 == 0:
            c = sorted((-sum(a * b for a, b in zip(e, f)), j) for j, f in good if j != q and len(f) == len(e))[:10]
            want.update((q, n + 1, j, -s) for n, (s, j) in enumerate(c))
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_repeated_query_rows_have_lists_of_their_own(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0, 0.5]), *((i, [i / 7, 1.0 - i]) for i in range(1, 30)), (30, None)]
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 10 == 0, 10, 4, 8).collect())
    want, fl = collections.Counter(), lambda v: [int(np.floor(1024 * x)) for x in v]
    for q, e in rows:
        if q % 10 == 0 and e:
            c = sorted((-sum(a * b for a, b in zip(fl(e), fl(f))), j) for j, f in rows if f and j != q)[:10]
            want.update((q, n + 1, j, -s) for n, (s, j) in enumerate(c))
    assert got == want


def test_scores_beyond_floats_are_exact():
    a = np.array([[2.0**30, 3.0 / 1024]])
    assert topk.scores(a, np.array([[2.0**10, 1.0 / 1024]]))[0, 0] == 2**60 + 3
    assert topk.scores(np.array([[2.0**60, 1.0]]), np.array([[2.0**-10, -1.0]]))[0, 0] == 2**63 - 1  # 2**70 counts as the greatest
    assert topk.scores(np.array([[-(2.0**52) - 1]]), np.array([[1 / 1024]]))[0, 0] == 1024 * (-(2**52) - 1)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    x, y = rng.integers(1, 9, 80).astype(float), rng.integers(1, 9, 80).astype(float)
    got = []
    for _ in range(20):
        e = rng.integers(0, 2**63, 80, dtype=np.uint64)
        s = darts.signatures(np.concatenate([e, e]), np.repeat([0, 1], 80), np.concatenate([x, y]), 2, 240)
        got.append((s[0] == s[1]).mean())
    assert np.mean(got) == pytest.approx(np.minimum(x, y).sum() / np.maximum(x, y).sum(), abs=0.03)


def _corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(r.randint(30, 90))] for _ in range(25)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(r.randint(0, 6)):
            c = list(b)
            for _ in range(r.randint(0, 3)):
                c[r.randrange(len(c))] = word()
            texts.append(" ".join(c))
    hot = [word() for _ in range(60)]
    for _ in range(60):
        c = list(hot)
        for _ in range(r.randint(1, 3)):
            c[r.randrange(60)] = word()
        texts.append(" ".join(c))
    return [*texts, *texts[:5], None, None, "", "", "  ", "a b", "a  b", "a b c"]


def _classes(texts):
    sets = [None if t is None or not t.split() else set(dedup.shingles(t, 5).tolist()) for t in texts]
    par = list(range(len(texts)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            near = sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if near or texts[i] is not None and texts[i] == texts[j]:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_and_keep_one(spark, monkeypatch):
    texts = _corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("d_key", F.lit(2)).repartition(3)
    want = _classes(texts)
    assert {r.doc_id: r.class_id for r in dedup.near_duplicates(docs).collect()} == dict(enumerate(want))
    kept = sorted(r.doc_id for r in dedup.keep_one(docs).collect())
    assert kept == [i for i in range(len(texts)) if want[i] == i]
    # Without hub rounds and with blocks of two, all links are found by the exact rest alone.
    monkeypatch.setattr(dedup, "BLOCK", 2)
    monkeypatch.setattr(dedup, "FEW", 2)
    got = dedup.near_duplicates(docs, dedup.DedupParams(rounds=0))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(want))


def test_near_duplicates_ask_few_jobs_of_the_driver(spark):
    """Its memory follows the jobs and plans of a run, so rounds of joins over few links would cost more than the links."""
    docs = spark.createDataFrame(list(enumerate(_corpus())), "doc_id long, text string").repartition(3)
    spark.sparkContext.setJobGroup("near", "jobs of near_duplicates")
    try:
        dedup.near_duplicates(docs).write.format("noop").mode("overwrite").save()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    assert 0 < jobs <= 120, jobs


def test_dedup_stage_asks_few_jobs_of_the_driver(spark):
    """Counted over the pipeline's second stage, as it fills a driver that the first has used; it keeps one text of each class."""
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = _corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spark.sparkContext.setJobGroup("stage", "jobs of the near_dedup stage")
    try:
        kept = sorted(r.doc_id for r in dict(pipeline.STAGES)["near_dedup"](spark, docs, "").collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = _classes(texts)
    assert kept == [i for i in range(len(texts)) if want[i] == i]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("stage"))
    assert 0 < jobs <= 120, jobs


def test_dedup_stage_sends_no_side_of_a_join_through_the_driver(spark):
    """A broadcast is collected and hashed by the driver, and the sides here grow with the input."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame(list(enumerate(_corpus())), "doc_id long, text string").repartition(3)
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()

    def listed():
        rows = store.executionsList()
        return [rows.apply(i) for i in range(rows.size())]

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    bus.waitUntilEmpty(30_000)
    seen = {x.executionId() for x in listed()}
    try:
        dict(pipeline.STAGES)["near_dedup"](spark, docs, "").write.format("noop").mode("overwrite").save()
        bus.waitUntilEmpty(30_000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plans = [x.physicalPlanDescription() for x in listed() if x.executionId() not in seen]
    assert any("SortMergeJoin" in x for x in plans) and not any("BroadcastExchange" in x for x in plans)


def test_components_by_joins_and_on_the_driver(spark, monkeypatch):
    r = random.Random(3)
    ids = [r.getrandbits(63) - 2**62 for _ in range(60)]
    chain = [(x, y) if r.random() < 0.5 else (y, x) for x, y in zip(ids[:40], ids[1:40], strict=False)]
    links = [*chain, chain[0], *[(ids[40], x) for x in ids[41:55]], (ids[55], ids[56]), (ids[57], ids[57])]
    want = {x: min(part) for part in (ids[:40], ids[40:55], ids[55:57]) for x in part}
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.comp for r in dedup.components(df).collect()} == want
    assert dedup.components(df.limit(0)).count() == 0
    monkeypatch.setattr(dedup, "LINKS", 0)
    assert {r.node: r.comp for r in dedup.components(df).collect()} == want


def test_near_duplicates_with_null_ids(spark):
    """Null ids lose no link and no class: the second text links two that are less alike; one class has no id at all."""
    words = [f"w{i}" for i in range(100)]
    swap = lambda n: " ".join(["x"] * n + words[n:])
    big = 2**60 + 1
    rows = [(big, swap(0)), (None, swap(8)), (big + 2, swap(16)), (None, "p q r s t u"), (None, "p q r s t u"), (None, None), (5, "alone in the whole wide world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.class_id) for r in dedup.near_duplicates(docs).collect())
    assert got == collections.Counter([(big, big), (None, big), (big + 2, big), (None, None), (None, None), (None, None), (5, 5)])
    kept = collections.Counter(tuple(r) for r in dedup.keep_one(docs).collect())
    assert kept == collections.Counter([rows[0], rows[3], rows[5], rows[6]])


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.near_duplicates(docs).count() == 0 and dedup.keep_one(docs).count() == 0


def test_counted_shingles(spark):
    one, many = "a b c d e f", " ".join(["a b c d e f"] * 6)
    assert dedup.similarity(*[w[0] for w in ([dedup.np.concatenate([np.unique(dedup.shingles(t, 5)).astype(np.uint32), np.ones(len(np.unique(dedup.shingles(t, 5))), np.uint32)]).tobytes()] for t in (one, one))], "count") == 1
    assert len(dedup.shingles(many, 5)) == 32


def test_hilbert_curve(spark):
    p = spark.range(512).select((F.col("id") % 8).alias("x"), F.expr("id div 8 % 8").alias("y"), F.expr("id div 64").alias("z"))
    pts = sorted(tuple(r) for r in p.select(shards.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3), "x", "y", "z").collect())
    assert [q[0] for q in pts] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(u[1:], v[1:])) == 1 for u, v in zip(pts, pts[1:]))


def test_shards(spark):
    rows = [(i % 40 if i < 90 else None, None if i % 7 == 0 else "x" * (i % 50), "en" if i % 3 else None, "hot" if i % 4 else None) for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash")).repartition(5)
    got = shards.shard_documents(docs).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert len(got) == 101 and sorted(slots) == list(range(8)) and {len(s) for s in slots.values()} == {12, 13}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = collections.Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    curve = sorted((r.shard, r.slot, r.curve_index) for r in got)
    assert [c for *_, c in curve] == sorted(c for *_, c in curve)
    assert shards.shard_documents(docs.limit(0)).count() == 0


def test_shards_of_null_and_repeated_ids(spark):
    """All rows with one id or none still make whole shards; repeated rows are rows each; a table under eight rows leaves shards empty."""
    rows = [(None, "same text")] * 40 + [(7, "same text")] * 45 + [(2**60 + 1, None)]
    got = shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("hot"), "s_cell": F.lit(1)}).repartition(3)).collect()
    assert len(got) == 86 and collections.Counter(r.doc_id for r in got) == {None: 40, 7: 45, 2**60 + 1: 1}
    assert {sum(r.shard == i for r in got) for i in range(8)} == {10, 11} and all(sorted(r.slot for r in got if r.shard == i) == list(range(sum(r.shard == i for r in got))) for i in range(8))
    few = shards.shard_documents(spark.createDataFrame([(1, "a", "en", "s"), (2, "b", "de", "t")], "doc_id long, text string, lang string, source string")).collect()
    assert [r.slot for r in few] == [0, 0] and len({r.shard for r in few}) == 2


def test_shard_files_are_pruned_by_every_dimension(spark, tmp_path):
    """Shards written out span few values of each dimension: far fewer than shards dealt by id do."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', int(pow(1.7, id % 17))) AS text", "concat('l', id * 7 % 11) AS lang", "concat('s', id * 13 % 29) AS source")
    dealt = shards.shard_documents(docs).select("doc_id", "shard").join(docs, "doc_id").withColumn("size", F.length("text"))
    path = str(tmp_path / "shards")
    dealt.withColumns(dict(zip(("h_source", "h_lang", "h_size"), shards.quantised(5)))).write.partitionBy("shard").parquet(path)
    spans = spark.read.parquet(path).groupBy("shard").agg(*[(F.max(c) - F.min(c) + 1).alias(c) for c in ("h_source", "h_lang", "h_size")]).collect()
    share = sum(r.h_source / 32 * r.h_lang / 32 * r.h_size / 32 for r in spans) / 8
    assert len(spans) == 8 and share < 0.3  # of the space that a shard's bounds take in; by id every shard takes it all


def _cells(rows):
    return pd.DataFrame(rows, columns=["source", "lang", "topic", "tokens"])


def test_raking_meets_marginals():
    rows = [(f"s{i % 3}", f"l{i % 2}", f"t{i % 5 % 2}", 10 + i * i) for i in range(30)]
    p = mixing.MixParams(rounds=12)
    got = mixing.fit_local(_cells(rows).groupby(list(mixing.DIMS), as_index=False).sum(), p)
    for d in mixing.DIMS:
        own, have = got.groupby(d)["tokens"].sum(), (got["tokens"] * got["weight"]).groupby(got[d]).sum()
        want = own ** p.power(d) / (own ** p.power(d)).sum()
        assert np.allclose(have / got["tokens"].sum(), want, rtol=1e-3)


def test_sample_meets_marginals():
    share = {"hot": 6, "a": 2, "b": 2, "x": 9, "y": 1.6, "prose": 8, "table": 2}
    rows = [(s, d, c, int(100 * share[s] * share[d] * share[c] * (1 + 0.2 * ((i + j + k) % 2)))) for i, s in enumerate(("hot", "a", "b")) for j, d in enumerate(("x", "y")) for k, c in enumerate(("prose", "table"))]
    p = mixing.MixParams()
    for rare in (0, 1):  # one class of few tokens cannot give its target: it is taken whole, and the rate stays
        got = mixing.fit_local(_cells(rows + rare * [(None, "x", "prose", 300)]), p)
        total, drawn = got["tokens"].sum(), got["tokens"] * got["probability"]
        assert got["probability"].between(0, 1).all() and (got["weight"] * p.rate > 1).any()
        assert drawn.sum() == pytest.approx(p.rate * total, rel=2e-3)
        for d in mixing.DIMS:
            own, have = (x.groupby(got[d].fillna("none")).sum() for x in (got["tokens"], drawn))
            whole = own.index == "none"
            left = p.rate * total - own[whole].sum()
            power = own[~whole] ** p.power(d)
            assert np.allclose(have[whole], own[whole], rtol=2e-3) and np.allclose(have[~whole], left * power / power.sum(), rtol=2e-3)


def test_fitting_by_joins_equals_fitting_on_the_driver(spark):
    rows = [(["hot", "a", None][i % 3], f"l{i % 2}", f"t{i % 5 % 2}", (10 + i * i) * (40 if i % 3 == 0 else 1)) for i in range(30)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).cache()
    p = mixing.MixParams(rounds=2, bounded_rounds=2)
    near, far = ({tuple(r)[:3]: (r.weight, r.probability) for r in mixing.fit_cells(cells, p, most)[0].collect()} for most in (100, 3))
    assert near.keys() == far.keys() and all(near[k] == pytest.approx(far[k], rel=1e-9) for k in near) and any(q == 1 for _, q in near.values())


def test_weights_equal_proportional_fitting():
    """Against the textbook loop over a dense array."""
    r = random.Random(6)
    n = np.array([[[r.randint(0, 9) * 10 for _ in range(3)] for _ in range(4)] for _ in range(5)], float)
    p, w = mixing.MixParams(), np.ones_like(n)
    power = [p.source_power, p.lang_power, p.topic_power]
    for _ in range(p.rounds):
        for axis in range(3):
            rest = tuple(a for a in range(3) if a != axis)
            target = n.sum(axis=rest) ** power[axis]
            w = w * np.expand_dims(target / target.sum() * n.sum() / (w * n).sum(axis=rest), rest)
    at = [(i, j, k) for i in range(5) for j in range(4) for k in range(3)]
    got = mixing.fit_local(_cells([(f"s{i}", f"l{j}", f"t{k}", int(n[i, j, k])) for i, j, k in at]), p)["weight"]
    assert np.allclose(got, [w[x] for x in at], rtol=1e-9)


def test_drawn_sample_meets_its_marginals(spark):
    """Documents drawn: every class holds what its target says, as nearly as chance allows (1 % of all tokens)."""
    docs = spark.range(60_000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 20)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source", "concat('l', id % 5 % 3) AS lang", "concat('t', id % 11 % 2) AS theme")
    p = mixing.MixParams(topic_column="theme")
    out, n = mixing.mix(docs, p)
    rows = [(x["source"], x["lang"], x["theme"], x["t"], x["s"]) for x in out.groupBy("source", "lang", "theme").agg(F.sum(n["tokens"]).alias("t"), F.sum(F.when(F.col(n["sampled"]), F.col(n["tokens"])).otherwise(0)).alias("s")).collect()]
    drawn = sum(x[4] for x in rows)
    assert drawn == pytest.approx(p.rate * sum(x[3] for x in rows), rel=0.01)
    for axis, power in enumerate((p.source_power, p.lang_power, p.topic_power)):
        own, have = collections.Counter(), collections.Counter()
        for x in rows:
            own[x[axis]] += x[3]
            have[x[axis]] += x[4]
        norm = sum(v**power for v in own.values())
        assert all(abs(have[k] / drawn - own[k] ** power / norm) < 0.01 for k in own)
    assert [x.doc_id for x in mixing.mixed(docs.limit(500), p).orderBy("doc_id").collect()] == [x.doc_id for x in mixing.mixed(docs.limit(500).repartition(3), p).orderBy("doc_id").collect()]


def test_mix(spark):
    rows = [(i if i % 9 else None, None if i % 10 == 0 else "w " * (i % 40), ["a", "b", None][i % 3], "en" if i % 2 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("m_weight", F.lit("clash")).withColumn("c_lang", F.lit("clash"))
    out, n = mixing.mix(docs)
    got = out.collect()
    assert len(got) == 300 and all(0 <= r[n["probability"]] <= 1 for r in got)
    expected = sum(r[n["tokens"]] * r[n["probability"]] for r in got)
    assert expected == pytest.approx(0.7 * sum(r[n["tokens"]] for r in got), rel=0.1)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs.limit(0)).count() == 0


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from ionloom.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").cache()
    stage = dict(pipeline.STAGES)
    kept = stage["quality"](spark, docs, sf).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one = stage["near_dedup"](spark, kept, sf).cache()
    rows = kept.orderBy("doc_id").collect()
    classes = _classes([r.text for r in rows])
    assert sorted(r.doc_id for r in one.collect()) == [rows[i].doc_id for i in range(len(rows)) if classes[i] == i]
    masked = stage["pii"](spark, one, sf)
    assert masked.count() == one.count() and masked.where("text rlike '[a-z]@[a-z]' or n_chars <> length(text)").count() == 0
    assert pipeline.run(spark, sf).columns == ["doc_id", "ids", "n_tokens"]
