"""Nearest labelled examples against plain loops: the index, the votes, their calibration, the whole query."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import toxicity
from ionloom.llm.toxicity import ToxicityParams


def _index(r, examples, terms, block):
    names = [f"t{i} 1" for i in range(terms)]
    vectors = {i: [t for t in names if r.random() < r.choice([0.05, 0.3])] for i in range(examples)}
    labels = {i: r.randint(0, 1) for i in range(examples)}
    idf = {t: r.choice([1.0, 1.5, 2.25]) for t in names}
    return toxicity.build(vectors, labels, {i: 1.0 + labels[i] for i in range(examples)}, idf, block), vectors, labels, idf


def _cosine(a, b, idf):
    norm = lambda v: math.sqrt(sum(idf[t] ** 2 for t in v))
    return sum(idf[t] ** 2 for t in set(a) & set(b)) / (norm(a) * norm(b)) if a and b else 0.0


@pytest.mark.parametrize("block", [1, 4, 64])
def test_nearest_are_exact(block):
    r = random.Random(block)
    for _ in range(25):
        index, vectors, labels, idf = _index(r, r.randint(0, 90), 40, block)
        for own in [-1, *list(vectors)[:5]]:
            q = vectors[own] if own >= 0 else [t for t in idf if r.random() < 0.2]
            at, cosines = index.nearest(*index.vector(q), 7, own)
            want = sorted((-_cosine(q, v, idf), i) for i, v in vectors.items() if i != own and set(q) & set(v))[:7]
            assert cosines.tolist() == pytest.approx([-c for c, _ in want])
            # Equal cosines stand in order of their places.
            assert all(a < b for a, b, x, y in zip(at, at[1:], cosines, cosines[1:]) if x == y)
            assert not [i for i, e in enumerate(index.ids.tolist()) if e != own and round(_cosine(q, vectors[e], idf), 6) == round(cosines[-1], 6) and cosines[-1] > 0 and i < at[cosines.round(6) == cosines[-1].round(6)].max() and i not in at] if len(at) == 7 else True
            assert all(_cosine(q, vectors[i], idf) == pytest.approx(c) for i, c in zip(index.ids[at].tolist(), cosines, strict=True))
            assert [labels[i] for i in index.ids[at].tolist()] == index.labels[at].tolist()
            weight = sum((1 + labels[i]) * c for i, c in zip(index.ids[at].tolist(), cosines, strict=True))
            toxic = sum((1 + labels[i]) * c * labels[i] for i, c in zip(index.ids[at].tolist(), cosines, strict=True))
            index.prior = 0.25
            assert index.vote(at, cosines, 2.0) == pytest.approx((toxic + 0.5) / (weight + 2.0))


def test_equal_cosines_go_to_first_places():
    index = toxicity.build({i: ["a 1"] for i in range(200)}, dict.fromkeys(range(200), 1), dict.fromkeys(range(200), 1.0), {"a 1": 1.0}, 16)
    at, cosines = index.nearest(*index.vector(["a 1"]), 5)
    assert at.tolist() == [0, 1, 2, 3, 4] and cosines.tolist() == [1.0] * 5
    assert index.ids[index.nearest(*index.vector(["a 1"]), 3, 1)[0]].tolist() == [0, 2, 3]


def test_blocks_below_the_bound_are_not_scored(monkeypatch):
    """Examples of one term share blocks, so a text of that term scores its blocks alone."""
    names = [f"t{i} 1" for i in range(20)]
    index = toxicity.build({i: [names[i // 50]] for i in range(1000)}, dict.fromkeys(range(1000), 0), dict.fromkeys(range(1000), 1.0), dict.fromkeys(names, 1.0), 10)
    calls = []
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: calls.append(1) or count(*a))
    at, _ = index.nearest(*index.vector(["t7 1", "t8 1"]), 5)
    assert len(at) == 5 and len(calls) <= 10 < len(index.starts)


def test_rising_is_the_least_squares_rising_fit():
    r = random.Random(2)
    for _ in range(50):
        x = np.array([r.choice([0.0, 0.1, 0.2, 0.5, 0.9, 1.0]) for _ in range(r.randint(1, 12))])
        y, w = np.array([float(r.randint(0, 1)) for _ in x]), np.array([r.choice([1.0, 3.0]) for _ in x])
        knots = toxicity.rising(x, y, w)
        fit = np.interp(x, *knots)
        assert (np.diff(knots[0]) > 0).all() and (np.diff(knots[1]) >= 0).all()
        # max-min form of the isotonic fit
        values = sorted(set(x))
        mean = lambda a, b: np.average(y[(x >= a) & (x <= b)], weights=w[(x >= a) & (x <= b)])  # noqa: B023, E731
        for v in values:
            want = max(min(mean(a, b) for b in values if b >= v) for a in values if a <= v)
            assert fit[x == v] == pytest.approx(want)


def test_known_terms_are_those_of_all(monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 8)))
    for _ in range(60):
        text = " ".join(word() for _ in range(r.randint(0, 40)))
        every = toxicity.terms(text)
        known = toxicity.Stems([*r.sample(every, min(6, len(every))), "abab~ 1", "zz 1", "ab 2"])
        asked = {f"{x} {k}" for x, ks in known.levels.items() for k in ks}
        assert sorted(known.terms_of(text)) == sorted(set(every) & asked)
    assert toxicity.Stems([]).terms_of("a b") == [] == toxicity.Stems(["a 1"]).terms_of(None)


def test_stems_have_levels():
    got = toxicity.terms("Moron moron, MORONIC moron moron 12")
    assert {"moron 1", "moron 2", "moron 4", "moronic 1", "moro~ 4", "moroni~ 1", "12 1"} <= set(got) and "moron 8" not in got
    assert toxicity.terms(None) == [] == toxicity.terms(" . ")


def _tables(spark, n=600):
    r = random.Random(11)
    calm, rude = [f"calm{i:02d}" for i in range(60)], ["idiot", "scum", "moron"]
    rows, marks = [], []
    for i in range(n):
        toxic = r.random() < 0.3
        w = [r.choice(calm) for _ in range(r.randint(5, 60))]
        if toxic:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randrange(len(w)), r.choice(rude))
        rows.append((i, " ".join(w)))
        if r.random() < 0.8:
            marks.append((i, int(toxic if r.random() < 0.97 else not toxic)))
    truth = {i: int(any(x in t for x in rude)) for i, t in rows}
    rows += [(n, None), (n + 1, ""), (n + 2, "!"), (None, "scum scum moron"), (3, rows[3][1]), (n + 3, "x " * 50_000 + "moron scum idiot idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("toxic", "h", "y", "i", "t", "o", "score")})
    labels = spark.createDataFrame([(i, 1, y) for i, y in marks] + [(n, 1, 0), (9, 0, None), (None, 0, 1), (10**9, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("z"))
    return rows, truth, docs.repartition(4), labels


def test_scores_of_a_table(spark):
    rows, truth, docs, labels = _tables(spark)
    out = toxicity.score_toxicity(docs, labels).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in out}
    assert by[None].predicted == 1 and by[603].predicted == 1 and by[600].score == by[601].score == by[602].score < 0.2
    assert set(by[603].terms) & {"idiot 1", "idiot 2", "scum 1", "moron 1"} and all(x.toxic for x in by[603].nearest)


def test_only_labels_that_are_not_held_out_are_learned(spark):
    _, _, docs, labels = _tables(spark)
    index = toxicity.fit(docs, labels)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, turned)
    assert again.terms == index.terms and np.array_equal(again.labels, index.labels) and np.array_equal(again.knots[1], index.knots[1])
    # Document frequencies are those of all documents.
    seen = toxicity.frequencies(docs, list(index.terms))
    want = collections.Counter(t for r in docs.select("text").collect() for t in toxicity.terms(r.text) if t in index.terms)
    assert seen == {**want, "": docs.count()}
    assert index.idf[index.terms["scum 1"]] == pytest.approx(math.log((docs.count() + 1) / (want["scum 1"] + 1)) + 1)


def test_the_sample_has_a_bound_and_repeated_texts_count_once(spark):
    docs = spark.createDataFrame([(i, "same idiot" if i % 2 else f"word{i} calm") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    picked, sizes = toxicity.sample(docs, labels, ToxicityParams(examples=20))
    assert collections.Counter(y for _, y in picked) == {0: 20, 1: 1} and sizes[1] == 1 and sizes[0] > 60
    assert len(toxicity.fit(docs, labels, ToxicityParams(examples=20, min_ratio=1.0)).labels) > 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.doc_id, r.score, r.predicted) for r in toxicity.score_toxicity(docs, none).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs, one).collect()} == {1.0}
    assert toxicity.score_toxicity(docs.limit(0), one).count() == 0


def test_blocks_are_scored_in_few_steps(monkeypatch):
    """Of 250 blocks whose bounds all reach the last of the nearest, steps are as many as doublings, and the nearest are those of all blocks."""
    r = random.Random(3)
    index, vectors, _, idf = _index(r, 1000, 30, 4)
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: calls.append(1) or count(*a))
    q = [t for t in idf if r.random() < 0.4]
    at, cosines = index.nearest(*index.vector(q), 16)
    assert len(index.starts) > 200 and len(calls) <= 6
    assert cosines.tolist() == pytest.approx(sorted((_cosine(q, v, idf) for v in vectors.values()), reverse=True)[:16])
