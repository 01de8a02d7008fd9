"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting. Examples are a bounded sample of the labelled rows: of each label the ``examples`` distinct texts first by
hash. Terms are words and beginnings of words; one that stands 2, 4, 8 ... times in a text is a term of its own for each of
these levels, so that term frequency counts by its logarithm and survives the unit length. Kept are the terms whose
presence in the examples tells the labels apart (a log-likelihood ratio of at least ``min_ratio``), ``max_terms`` at most;
their document frequencies are counted over all documents. An example is its unit vector of the idf of these terms.
Examples are ordered so that those of like terms are neighbours and cut into blocks; the index holds postings by
(block, term) and the largest weight of each term in each block.

Search. A text's terms bound its cosine with every example of a block by the sum of products with the block's
largest weights. Blocks are scored whole, the highest bounds first, 8 at once, then 16, 32 ..., until no bound reaches the k-th cosine, so the
k nearest examples are exact (cosines of 9 decimals, ties: first places in the index).

Score. Neighbours vote for their label by their cosine, each label weighted by how many labelled texts an example of
it stands for, and ``smoothing`` votes are cast by the share of toxic texts among those without a term.
Votes of the examples themselves, each without itself, are made monotone against their labels (pooled adjacent
violators), which turns a vote into a calibrated score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
BEGINNINGS = (4, 6)
LEVELS = (1, 2, 4, 8, 16)
#: Cosines count by so many decimals, so that rounding does not decide among equal ones.
DECIMALS = 9
#: Blocks that a search scores at once at first, twice as many in each next step.
FIRST_BLOCKS = 8
#: Results of so many different term sets are kept by a worker, which changes speed but not results.
KNOWN = 20_000


@dataclass(frozen=True)
class ToxicityParams:
    #: Distinct labelled texts of each label that are learned from, at most: the bound of what is fitted and sent to executors.
    examples: int = 4096
    max_terms: int = 1024
    #: The log-likelihood ratio (chi-squared, one degree of freedom) of a term and the label; 20 is a chance of 1 in 130,000.
    min_ratio: float = 20.0
    neighbours: int = 16
    block: int = 64
    smoothing: float = 1.0
    evidence: int = 3


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is divisible by 5 (null ids: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def stems(text: str | None) -> Counter:
    """The words of a text, in lower case, and the beginnings of its longer words (marked by ``~``), with their counts."""
    if not text:
        return Counter()
    w = WORD.findall(text.lower())
    out = Counter(w)
    for n in BEGINNINGS:
        out.update([x[:n] + "~" for x in w if len(x) > n])
    return out


def terms(text: str | None) -> list[str]:
    """The terms of a text: each stem with every level that its count reaches."""
    return [f"{x} {k}" for x, n in stems(text).items() for k in LEVELS if n >= k]


class Stems:
    """The stems of given terms with their levels, and the terms among them that a text has."""

    def __init__(self, of: Iterable[str]):
        self.levels: dict[str, list[int]] = {}
        for t in dict.fromkeys(of):
            stem, level = t.split(" ")
            self.levels.setdefault(stem, []).append(int(level))
        whole = [x for x in self.levels if not x.endswith("~")]
        self.words = set(whole)
        self.heads = [(n, itemgetter(slice(0, n)), {x[:-1] for x in self.levels if x.endswith("~") and len(x) == n + 1}) for n in BEGINNINGS]

    def terms_of(self, text: str | None) -> list[str]:
        """As ``terms`` has them, of the known ones: texts are asked for any known beginning before one is counted."""
        if not text:
            return []
        c = Counter(WORD.findall(text.lower()))
        found = {w: c[w] for w in self.words & c.keys()}
        for n, head, known in self.heads:
            if known and not known.isdisjoint(map(head, c)):
                for w, k in c.items():
                    if w[:n] in known and len(w) > n:
                        found[w[:n] + "~"] = found.get(w[:n] + "~", 0) + k
        return [f"{x} {k}" for x, n in found.items() for k in self.levels[x] if n >= k]


@dataclass
class Index:
    """Unit vectors of examples by (block, term), with each block's largest weight of each term."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray  # example numbers in index order
    labels: np.ndarray  # by place in the index
    votes: np.ndarray  # labelled texts that an example stands for, by place
    block: int
    starts: np.ndarray = field(repr=False)  # postings of (block, term): starts[b, t] to starts[b, t + 1]
    places: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    most: np.ndarray = field(repr=False)  # by term and block
    prior: float = 0.0
    #: Calibration: scores by rising votes.
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def __post_init__(self) -> None:
        self.stems = Stems(self.terms)

    def vector(self, present: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of a text's terms those in the index, in order, and their unit weights."""
        t = np.array(sorted(self.terms[x] for x in present), np.int64)
        w = self.idf[t]
        return t, w / (np.sqrt((w * w).sum()) or 1)

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples with a term of the text, nearest first (ties: first places), without the example ``own``."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(t) or not len(self.ids):
            return none
        # Sums of rounded products may pass their bound by a few units in the last place.
        bounds = np.round((w @ self.most[t]) * (1 + 1e-12), DECIMALS)
        left = np.argsort(-bounds, kind="stable")
        left = left[bounds[left] > 0]
        (at, cosines), size = none, FIRST_BLOCKS
        while len(left):
            if len(at) == k:
                # Those that could tie with the last at best go too where it stands before them, as ties go to first places.
                reach = bounds[left]
                left = left[(reach > cosines[-1]) | (reach == cosines[-1]) & (left * self.block <= at[-1])]
            now, left, size = left[:size], left[size:], size * 2
            new, found = self.scored(now, t, w, cosines[-1] if len(at) == k else 0.0)
            if own >= 0:
                keep = self.ids[new] != own
                new, found = new[keep], found[keep]
            if len(found) > k:
                keep = found >= np.partition(found, len(found) - k)[len(found) - k]
                new, found = new[keep], found[keep]
            at, cosines = np.concatenate([at, new]), np.concatenate([cosines, found])
            order = np.lexsort((at, -cosines))[:k]
            at, cosines = at[order], cosines[order]
        return at, cosines

    def scored(self, blocks: np.ndarray, t: np.ndarray, w: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the examples of ``blocks`` whose cosine is above 0 and ``least`` or more."""
        first = self.starts[blocks[:, None], t]
        sizes = self.starts[blocks[:, None], t + 1] - first
        flat = sizes.ravel()
        post = np.repeat(first.ravel() - np.cumsum(flat) + flat, flat) + np.arange(flat.sum())
        row = np.repeat(np.arange(len(blocks)) * self.block, sizes.sum(axis=1))
        products = np.repeat(np.tile(w, len(blocks)), flat) * self.weights[post]
        found = np.round(np.bincount(row + self.places[post], products, len(blocks) * self.block), DECIMALS)
        new = np.flatnonzero((found > 0) & (found >= least))
        return blocks[new // self.block] * self.block + new % self.block, found[new]

    def vote(self, at: np.ndarray, cosines: np.ndarray, smoothing: float) -> float:
        """The share of toxic votes, 0 to 1."""
        weight = cosines * self.votes[at]
        return float(((weight * self.labels[at]).sum() + smoothing * self.prior) / (weight.sum() + smoothing))

    def score(self, vote: float) -> float:
        return float(np.interp(vote, *self.knots))


def build(vectors: dict[int, list[str]], labels: dict[int, int], votes: dict[int, float], idf: dict[str, float], block: int) -> Index:
    """An index of examples, given as their terms in ``idf``. Examples whose heaviest terms are alike share blocks."""
    number = {t: i for i, t in enumerate(sorted(idf))}
    out = Index(number, np.array([idf[t] for t in number], np.float64), *(np.zeros(0, np.int64),) * 3, block, *(np.zeros(0),) * 4)
    own = {i: out.vector(c) for i, c in vectors.items()}
    heaviest = lambda i: (own[i][0][np.argsort(-own[i][1], kind="stable")[:3]].tolist(), i)
    ids = sorted((i for i in own if len(own[i][0])), key=heaviest)
    blocks = -(-len(ids) // block)
    rows = np.concatenate([np.full(len(own[i][0]), n) for n, i in enumerate(ids)]) if ids else np.zeros(0, np.int64)
    t = np.concatenate([own[i][0] for i in ids]) if ids else np.zeros(0, np.int64)
    w = np.concatenate([own[i][1] for i in ids]) if ids else np.zeros(0)
    order = np.lexsort((rows, t, rows // block))
    rows, t, w = rows[order], t[order], w[order]
    edges = np.searchsorted((rows // block) * len(number) + t, np.arange(blocks * len(number) + 1))
    # Row b holds the edges of its terms; the last edge of a row is the first of the next.
    out.starts = np.stack([edges[b * len(number) : (b + 1) * len(number) + 1] for b in range(blocks)]) if blocks else np.zeros((0, len(number) + 1), np.int64)
    out.places, out.weights, out.ids = rows % block, w, np.array(ids, np.int64)
    out.most = np.zeros((len(number), blocks))
    np.maximum.at(out.most, (t, rows // block), w)
    out.labels, out.votes = np.array([labels[i] for i in ids], np.float64), np.array([votes[i] for i in ids], np.float64)
    return out


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (x, mean of y) of the best rising step function, each step from its least to its greatest x."""
    values, own = np.unique(x, return_inverse=True)
    tops, sums = np.bincount(own, weight * y, len(values)), np.bincount(own, weight, len(values))
    steps: list[list[float]] = []  # least x, greatest x, sum of weight * y, sum of weight
    for v, top, total in zip(values.tolist(), tops.tolist(), sums.tolist(), strict=True):
        new = [v, v, top, total]
        while steps and steps[-1][2] * new[3] >= new[2] * steps[-1][3]:
            a = steps.pop()
            new = [a[0], v, a[2] + new[2], a[3] + new[3]]
        steps.append(new)
    if not steps:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    at = [(e, s[2] / s[3]) for s in steps for e in sorted({s[0], s[1]})]
    return np.array([a for a, _ in at]), np.array([b for _, b in at])


def sample(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """((text hash, label) of the examples, labelled distinct texts by label), from labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h")).join(known, "doc_id").select("h", "y").distinct()
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return [(r["h"], y) for y in sorted(sizes) for r in rows.where(F.col("y") == y).orderBy("h").limit(p.examples).collect()], sizes


def ratio(k1: Column, n1: Column, k0: Column, n0: Column) -> Column:
    """The log-likelihood ratio of k1 of n1 and k0 of n0."""
    part = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
    side = lambda k, n: part(k, n) + part(n - k, n)
    return 2 * (side(k1, n1) + side(k0, n0) - part(k1 + k0, n1 + n0) - part(n1 + n0 - k1 - k0, n1 + n0))


def term_rows(texts: DataFrame) -> DataFrame:
    """(i, term) of the terms of rows (i, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = terms(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array(own, pa.string())], ["i", "term"])

    return texts.mapInArrow(run, "i bigint, term string")


def frequencies(docs: DataFrame, of: list[str]) -> dict[str, int]:
    """Documents that hold each of the terms, over all documents, and under "" all of them; each task sends a row per term at most."""
    shared = docs.sparkSession.sparkContext.broadcast(Stems(of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = Counter(), shared.value
        for b in batches:
            for t in b.column(0):
                seen.update(["", *known.terms_of(t.as_py())])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    return {r["term"]: r["n"] for r in docs.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> Index:
    """The index of the labelled examples, calibrated on them. No labelled row: an empty index, whose scores are 0.

    The driver holds 2 * ``examples`` examples of ``max_terms`` terms at most, never a text.
    """
    picked, sizes = sample(docs, labels, p)
    labelled = Counter(y for _, y in picked)
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(h, y, i) for i, (h, y) in enumerate(picked)], "h bigint, y int, i bigint")
    # Equal texts share a hash, so the first of each example is its text.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "h").select("i", "text")
    texts = texts.groupBy("i").agg(F.min("text").alias("text")) if picked else texts
    rows = term_rows(texts)
    told = rows.join(F.broadcast(chosen), "i").groupBy("term").agg(F.count_if(F.col("y") == 1).cast("double").alias("k1"), F.count_if(F.col("y") == 0).cast("double").alias("k0"))
    n1, n0 = (F.lit(float(labelled[y])) for y in (1, 0))
    told = told.withColumn("g", ratio(F.col("k1"), n1, F.col("k0"), n0)).where(F.col("g") >= p.min_ratio)
    best = [r["term"] for r in told.orderBy(F.col("g").desc(), "term").limit(p.max_terms).collect()] if len(labelled) == 2 else []
    vectors: dict[int, list[str]] = {i: [] for i in range(len(picked))}
    if best:
        wanted = spark.createDataFrame([(t,) for t in best], "term string")
        for r in rows.join(F.broadcast(wanted), "term").collect():
            vectors[r["i"]].append(r["term"])
    seen = frequencies(docs, best) if best else {}
    idf = {t: math.log((seen.get("", 0) + 1) / (seen.get(t, 0) + 1)) + 1 for t in best}
    stands = {y: sizes[y] / labelled[y] for y in labelled}
    out = build(vectors, {i: y for i, (_, y) in enumerate(picked)}, {i: stands[y] for i, (_, y) in enumerate(picked)}, idf, p.block)
    bare = [(stands[y], y) for i, (_, y) in enumerate(picked) if not vectors[i]]
    out.prior = sum(s * y for s, y in bare) / (sum(s for s, _ in bare) or 1)
    return calibrated(out, vectors, picked, stands, p)


def calibrated(index: Index, vectors: dict[int, list[str]], picked: list[tuple[int, int]], stands: dict[int, float], p: ToxicityParams) -> Index:
    """The index with scores fitted to the votes of its examples, each asked without itself."""
    votes = [index.vote(*index.nearest(*index.vector(vectors[i]), p.neighbours, i), p.smoothing) for i in range(len(picked))]
    if votes:
        index.knots = rising(np.array(votes), np.array([float(y) for _, y in picked]), np.array([stands[y] for _, y in picked]))
    return index


def classify(docs: DataFrame, index: Index, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted and evidence: the nearest examples' cosine and label, and the text's heaviest terms.

    Null, empty and other texts without a term of the index have the calibrated share of toxic texts among examples without one.
    Repeated rows have equal results, null ids stay (not held out), other columns play no part, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("i"), held_out(F.col("doc_id")).alias("o"), F.col("text").alias("t"))
    near = pa.list_(pa.struct([("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        name, kept = [*x.terms], {}
        for b in batches:
            rows = []
            for text in b.column(2):
                t, w = x.vector(x.stems.terms_of(text.as_py()))
                row = kept.get(key := t.tobytes())
                if row is None:
                    at, cosines = x.nearest(t, w, p.neighbours)
                    near_by = [{"cosine": c, "toxic": int(y)} for c, y in zip(cosines[: p.evidence].tolist(), x.labels[at[: p.evidence]], strict=True)]
                    row = x.score(x.vote(at, cosines, p.smoothing)), near_by, [name[k] for k in t[np.argsort(-w, kind="stable")[: p.evidence]]]
                    if len(kept) >= KNOWN:
                        kept.clear()
                    kept[key] = row
                rows.append(row)
            scores, found, heavy = zip(*rows, strict=True) if rows else ((), (), ())
            said = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), said, pa.array(found, near), pa.array(heavy, pa.list_(pa.string()))], ["i", "o", "score", "predicted", "nearest", "terms"])

    out = rows.mapInArrow(run, f"i {kind}, o boolean, score double, predicted int, nearest array<struct<cosine double, toxic int>>, terms array<string>")
    return out.select(F.col("i").alias("doc_id"), F.col("o").alias("held_out"), "score", "predicted", "nearest", "terms")


def score_toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """``classify`` of every row of ``docs`` by what ``fit`` learns from the labelled rows that are not held out."""
    docs = docs.select("doc_id", "text")
    return classify(docs, fit(docs, labels.select("doc_id", "toxic"), p), p)
