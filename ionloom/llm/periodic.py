"""Periodic run detection: prefix hashes over words, longest common extensions at the points of a harmonic grid.

For every period p only the words at multiples of p are asked how far the text before and after them equals
itself p words on (n/1 + n/2 + ... points in all). A run of period p and at least 2p words holds such a point
whose word equals that p words on and before which less than p words agree, so each run is met once per
period. All (period, point) pairs of a slice of documents are arrays: pairs whose words differ go first,
then those whose agreement is too short on both sides by one hash probe of half the needed length, and the
rest find both extensions by binary search at once. What multiples of a period find is the same stretch of
words, so stretches keep their smallest period, and the words of each are compared before it counts.

Hashes are sums of powers modulo 2**64 and modulo a prime below 2**31. A document in which a comparison of
words refutes them is done again by comparing its words alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words and (period, point) pairs that a task handles at once; one longer text is a slice, one longer period a block of its own.
SLICE_WORDS = 1 << 17
BLOCK_PAIRS = 1 << 20
PRIME = np.uint64(2**31 - 1)
BASE, SMALL_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1_000_003)


@dataclass(frozen=True)
class RunParams:
    #: A run has at least so many words, and at least twice its period.
    min_words: int = 12


def words(text: str | None) -> list[str]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    if not text:
        return []
    for c in "\t\n\x0b\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


class Hashes:
    """Prefix hashes of a row of word numbers; ``same`` tells whether stretches of two places are equal."""

    def __init__(self, w: np.ndarray):
        n = len(w)
        z = (w.astype(np.uint64) + np.uint64(1)) * BASE  # word numbers, mixed
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        self.power = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, BASE), out=self.power[1:])
        self.small = np.ones(n + 1, np.uint64)
        done, step = 1, SMALL_BASE
        while done <= n:  # powers by doubling
            k = min(done, n + 1 - done)
            self.small[done : done + k] = self.small[:k] * step % PRIME
            step, done = step * step % PRIME, done + k
        self.wide = np.zeros(n + 1, np.uint64)
        np.cumsum(z * self.power[:n], out=self.wide[1:])
        self.narrow = np.zeros(n + 1, np.uint64)
        np.cumsum(z % PRIME * self.small[:n] % PRIME, out=self.narrow[1:])
        self.narrow %= PRIME

    def same(self, i: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the hashes of words [i, i + length) and of those p words on agree."""
        j, a, b = i + p, self.wide, self.narrow
        ok = (a[i + length] - a[i]) * self.power[p] == a[j + length] - a[j]
        at = np.flatnonzero(ok)
        i, j, p, length = i[at], j[at], p[at], length[at]
        ok[at] = (b[i + length] + PRIME - b[i]) % PRIME * self.small[p] % PRIME == (b[j + length] + PRIME - b[j]) % PRIME
        return ok

    def reach(self, i: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest extension forward from i, or back from it, of at most ``most`` words: binary searches side by side."""
        low, high = np.zeros_like(i), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            lo, hi, at = low[open_], high[open_], i[open_]
            mid = (lo + hi + 1) // 2
            ok = self.same(at - mid if back else at, p[open_], mid)
            low[open_], high[open_] = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return low


def _pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, point) of all grid points that have a word one period on, in blocks."""
    halves = (ends - starts) // 2
    doc = np.repeat(np.arange(len(starts)), halves)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    points = (ends[doc] - starts[doc] - 1) // period
    total = np.cumsum(points)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
        n = points[at:to]
        own = np.repeat(np.arange(at, to), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        yield doc[own], period[own], starts[doc[own]] + step * period[own]
        at = to


def _needed(p: np.ndarray, min_words: int) -> np.ndarray:
    """Words that must agree with those one period on for a run of period p."""
    return np.maximum(p, min_words - p)


def by_hashes(w: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_words: int) -> np.ndarray:
    """Rows (document, first word, length, period) of the stretches that hashes find, with the smallest period of each."""
    h, found = Hashes(w), []
    for doc, p, i in _pairs(starts, ends):
        at = np.flatnonzero(w[i] == w[i + p])
        doc, p, i = doc[at], p[at], i[at]
        half = (_needed(p, min_words) + 1) // 2
        ok = np.zeros(len(i), bool)
        on = np.flatnonzero(i + p + half <= ends[doc])
        ok[on] = h.same(i[on], p[on], half[on])
        on = np.flatnonzero(~ok & (i - half >= starts[doc]))
        ok[on] = h.same(i[on] - half[on], p[on], half[on])
        at = np.flatnonzero(ok)
        doc, p, i = doc[at], p[at], i[at]
        later = np.zeros(len(i), bool)  # the stretch has a grid point one period before
        on = np.flatnonzero(i - p >= starts[doc])
        later[on] = h.same(i[on] - p[on], p[on], p[on])
        doc, p, i = doc[~later], p[~later], i[~later]
        back = h.reach(i, p, np.minimum(i - starts[doc], p - 1), True)
        forth = h.reach(i, p, ends[doc] - i - p, False)
        ok = back + forth >= _needed(p, min_words)
        found.append(np.stack([doc, i - back, back + forth + p, p], 1)[ok])
    return _smallest(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of rows with one (document, start, length) that of the smallest period; in order of document, start and period."""
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def refuted(w: np.ndarray, runs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Documents with a stretch whose words do not repeat, or that a neighbouring word extends."""
    bad = []
    for doc, start, length, p in runs.tolist():
        end = start + length
        whole = np.array_equal(w[start : end - p], w[start + p : end])
        longer = start > starts[doc] and w[start - 1] == w[start - 1 + p] or end < ends[doc] and w[end] == w[end - p]
        if not whole or longer:
            bad.append(doc)
    return np.unique(np.array(bad, np.int64))


def by_words(w: np.ndarray, min_words: int) -> np.ndarray:
    """Rows (0, first word, length, period) of one document by comparing its words with those one period on, for each period."""
    found = [np.zeros((0, 4), np.int64)]
    for p in range(1, len(w) // 2 + 1):
        edge = np.diff(np.concatenate([[0], (w[:-p] == w[p:]).astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ok = b - a >= max(p, min_words - p)
        found.append(np.stack([0 * a[ok], a[ok], b[ok] - a[ok] + p, 0 * a[ok] + p], 1))
    return _smallest(np.concatenate(found))


def find(w: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_words: int = 12) -> np.ndarray:
    """Rows (document, first word, length, period) of every run, by document, start and period; words count from the row's first."""
    runs = by_hashes(w, starts, ends, min_words)
    for doc in refuted(w, runs, starts, ends).tolist():
        own = by_words(w[starts[doc] : ends[doc]], min_words) + [doc, starts[doc], 0, 0]
        runs = np.concatenate([runs[runs[:, 0] < doc], own, runs[runs[:, 0] > doc]])
    return runs


def _slices(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """Words of texts, in slices of at least one text and about ``SLICE_WORDS`` words."""
    held, n = [], 0
    for t in texts:
        held.append(words(t))
        n += len(held[-1])
        if n >= SLICE_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _slice(texts: list[list[str]], min_words: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Runs of each text as (text, start, length, period) with starts from the text's first word, words of each, collapsed texts."""
    code: dict[str, int] = {}
    w = np.fromiter((code.setdefault(x, len(code)) for t in texts for x in t), np.int64)
    n = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    runs = find(w, starts, ends, min_words)
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
    stays = np.cumsum(edge)[:-1] == 0
    hit = set(runs[:, 0].tolist())
    out = [" ".join([x for x, s in zip(t, stays[starts[i] : ends[i]].tolist(), strict=True) if s] if i in hit else t) for i, t in enumerate(texts)]
    return runs - np.stack([0 * runs[:, 0], starts[runs[:, 0]], 0 * runs[:, 0], 0 * runs[:, 0]], 1), n, out


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, text: Column | None = None, id_col: str = "doc_id", p: RunParams = RunParams()) -> DataFrame:
    """Per row: the id, n_words, runs (array of start, length, period, by start and period) and the collapsed text.

    A run is a stretch of words with smallest period q (words q apart are equal) of at least ``max(min_words, 2 * q)`` words that no
    neighbouring word extends; words count from 0. ``collapsed`` joins by one space the words that no run contains after its first
    q. ``text`` is the column ``text`` unless another is given. Null and blank texts: no word, no run, an empty text. Repeated rows
    have equal results, ids of any type pass as they are, also null ones, other columns play no part, an empty table gives no rows.
    No shuffle; a task holds a slice of words, so that memory follows the longest text, as (n ln n) grid points in blocks.
    """
    rows = docs.select(F.col(id_col).alias("i"), (F.col("text") if text is None else text).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in _slices(b.column(1).to_pylist()):
                runs, n, collapsed = _slice(texts, p.min_words)
                cells = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(RUN))
                edges = pa.array(np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(edges, cells)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(n), lists, pa.array(collapsed, pa.string())], ["i", "n_words", "runs", "collapsed"])
                at += len(texts)

    out = rows.mapInArrow(run, f"i {kind}, n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string")
    return out.select(F.col("i").alias(id_col), "n_words", "runs", "collapsed")


def planted(docs: DataFrame, words_of: Column) -> Column:
    """Text of the query's contract: of documents whose crc32(doc_id) ends in 0 the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.size(words_of).cast("bigint")
    g = F.floor(h / 10).cast("bigint")
    a = g % n
    period = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
    copies = F.ceil((n - a) / period).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words_of, (a + 1).cast("int"), period.cast("int")), copies))
    whole = F.slice(F.concat(F.slice(words_of, F.lit(1), a.cast("int")), tail), F.lit(1), n.cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(F.col("text"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the query returns of ``find_runs``: the number of runs, the longest one (ties: first, then shortest period) and hashes."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    out = found.select(id_col, F.size("runs").cast("bigint").alias("n_runs"), best.alias("__b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    length, start, period = F.col("__b.l"), -F.col("__b.s"), -F.col("__b.p")
    return out.select(id_col, "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
