"""Periodic runs against brute force: every period, every stretch, its smallest period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionloom.llm import periodic
from ionloom.llm.common import words_of


def brute(w, least=12):
    """(start, period, length) of all runs, from the definition."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j - i + q), q)  # periods rise, so the first is the smallest
            i = j
    return sorted((s, q, length) for (s, length), q in best.items())


def found(docs, least=12):
    n = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(n)
    runs = periodic.find(np.array([x for d in docs for x in d], np.int64), ends - n, ends, least)
    return [[(a - (ends - n)[i], p, length) for d, a, length, p in runs.tolist() if d == i] for i in range(len(docs))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), min_size=1, max_size=5))
def test_runs_of_several_texts(docs):
    assert found(docs) == [brute(d) for d in docs]
    assert found(docs, 4) == [brute(d, 4) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 15), st.integers(0, 60), st.lists(st.integers(0, 30), max_size=20))
def test_planted_periods(head, period, more, tail):
    d = head + [head[-(i % period % len(head)) - 1] for i in range(more)] + tail
    assert found([d, d[::-1]]) == [brute(d), brute(d[::-1])]


def test_comparing_words_alone_finds_the_same():
    r = random.Random(3)
    for _ in range(100):
        d = [r.randrange(3) for _ in range(r.randint(0, 60))]
        assert [(a, p, n) for _, a, n, p in periodic.by_words(np.array(d, np.int64), 12).tolist()] == brute(d)


def test_hashes_that_words_refute_are_replaced(monkeypatch):
    """With hashes that call everything equal, each text is done again by its words."""
    docs = [[i % 5 for i in range(40)], list(range(30)), [1, 2] * 10 + [3] * 15]
    monkeypatch.setattr(periodic.Hashes, "same", lambda self, i, p, length: np.ones(len(i), bool))
    w = np.array([x for d in docs for x in d], np.int64)
    ends = np.cumsum([len(d) for d in docs])
    starts = ends - [len(d) for d in docs]
    assert 0 in periodic.refuted(w, np.array([[0, 0, 30, 5]]), starts, ends)
    assert found(docs)[2] == brute(docs[2])


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_of_pairs_do_not_matter(monkeypatch, block):
    docs = [[i % 7 for i in range(60)], [], [1] * 25, [5]]
    monkeypatch.setattr(periodic, "BLOCK_PAIRS", block)
    assert found(docs) == [brute(d) for d in docs]


def test_long_and_hard_rows_of_words():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    thue = [bin(i).count("1") & 1 for i in range(1 << 11)]
    assert found([b[:1500]])[0] == brute(b[:1500]) and found([thue])[0] == brute(thue)
    assert found([[7] * 400_000])[0] == [(0, 1, 400_000)]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def contract(doc_id, text):
    """The query's row, from the contract alone."""
    w = split(text)
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[2], -r[0], -r[1]), default=None)
    of = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cells = (top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4
    return (doc_id, len(runs), *cells, of("".join(f"{s},{length},{q}\n" for s, q, length in runs)), of(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_rows(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 80))) for _ in range(150)]
    texts += [" ".join(f"w{r.randrange(40)}" for _ in range(r.randint(1, 60))) for _ in range(150)]
    texts += [None, "", " \t\n ", "a b \x1c c\r\nd", "é ü " * 30, "x " * 5000, " a  b\ta b\na b a b a b a b a b "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 9), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("i", "t", "runs", "n_words", "h")}).repartition(3)
    got = periodic.digests(periodic.find_runs(docs, periodic.planted(docs, words_of(F.col("text")))))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(contract(*x)) for x in rows)
    assert sum(x.n_runs > 0 for x in got.collect()) > 20
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_operator_returns_runs_and_text(spark):
    docs = spark.createDataFrame([("k", "a b c " * 5 + "d"), ("m", None)], "doc_id string, text string")
    got = {x.doc_id: x for x in periodic.find_runs(docs).collect()}
    assert [tuple(x) for x in got["k"].runs] == [(0, 15, 3)] and got["k"].collapsed == "a b c d" and got["k"].n_words == 16
    assert got["m"].runs == [] and got["m"].collapsed == "" and got["m"].n_words == 0
    assert [tuple(x) for x in periodic.find_runs(docs, p=periodic.RunParams(min_words=16)).where("doc_id = 'k'").first().runs] == []
