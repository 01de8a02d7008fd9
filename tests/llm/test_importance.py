"""Importance resampling against the contract, written out plainly."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionloom.llm import importance
from ionloom.llm.importance import ImportanceParams

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def contract(docs, target, least=20, percent=5, buckets=10_000):
    s, t = collections.Counter(), collections.Counter()
    made = [(i, *grams(x)) for i, x in docs]
    of = lambda g: zlib.crc32(g.encode()) % buckets
    for _, _, g in made:
        s.update(map(of, g))
    for x in target:
        t.update(map(of, grams(x)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    rows = []
    for i, n, g in made:
        weight = sum(gain[of(x)] for x in g)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(repr((*r[:4], rank.get(id(r)))) for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_and_buckets(text):
    n, g = grams(text)
    got_n, got = importance.features(text, ImportanceParams())
    assert got_n == n and sorted(got.tolist()) == sorted(zlib.crc32(x.encode()) % 10_000 for x in g)
    assert importance.unpack(importance.pack(got)).tolist() == sorted(got.tolist())


def _texts():
    r = random.Random(4)
    word = lambda: r.choice(["The", "a", "éa", "x1", "Zoo", "dog", "cat", "run"]) + r.choice(["", ".", ",", "\n"])
    texts = [" ".join(word() for _ in range(r.randint(0, 90))) for _ in range(240)]
    return [*texts, *[texts[3]] * 400, *[texts[4]] * 3, None, None, "", "  ", "!!", "Ünï-CODE", "w " * 30_000]


def test_query_rows(spark):
    texts = _texts()
    docs = [*enumerate(texts), (7, texts[7]), (7, texts[7]), (None, texts[9]), (None, None)]
    target = ["the dog run", None, "", "a Cat a cat zoo", "x1 x1 x1"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("i", "t", "row", "digest", "weight", "rank", "salt")}).repartition(5)
    bench = spark.createDataFrame([(x,) for x in target], "text string").withColumn("times", F.lit(3))
    got = importance.resample(df, bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(repr(tuple(r)) for r in got.collect()) == contract(docs, target)


def test_other_parameters_and_empty_tables(spark):
    docs = [(i, "one two three four five " * (i % 9)) for i in range(120)]
    df, none = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string")
    got = importance.resample(df, none, ImportanceParams(buckets=97, min_words=6, percent=50))
    assert sorted(repr(tuple(r)) for r in got.collect()) == contract(docs, [], 6, 50, 97)
    assert importance.resample(df.limit(0), none).count() == 0


def test_each_distinct_text_is_featurised_once(spark):
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(100)], "doc_id long, text string")
    rows = importance.collapsed(docs, ImportanceParams()).collect()
    assert len(rows) == 5 and {r.times for r in rows} == {20}


def test_hot_texts_are_dealt_by_a_salt(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"cold {i}") for i in range(300)], "i long, text string")
    texts = importance.weighed(importance.collapsed(docs, ImportanceParams()), np.arange(10_000))
    got = importance.joined_back(docs, texts, 300)
    assert got.count() == 300 and got.where("weight is null").count() == 0
    monkeypatch.setattr(importance, "HOT", 2)
    salted = importance.joined_back(docs, texts, 300)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("parts", ["1", "7"])
def test_ranks_over_ranges(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = importance.cut(spark.createDataFrame([(i, i % 3) for i in range(200)], "i long, score long"))
        got = {r.i: r["rank"] for r in importance.ranked(rows, F.col("i") < 150, 40).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {i: k + 1 for k, i in enumerate(sorted(range(150), key=lambda i: (-(i % 3), i))[:40])}
    assert got == {i: want.get(i) for i in range(200)}
