"""MinHash near-dedup: DartMinHash signatures, banded joining, exact check, connected components.

Texts are compared as sets of five-word shingles; near copies have a Jaccard similarity of 0.8 or more. Equal
texts are one node (named by a 64-bit hash of the text) before anything is joined, so copies cost one row.

A band is a run of ``rows`` signature coordinates; nodes of equal bands share a bucket. Buckets are never expanded
into pairs. In a round each bucket names hubs (by a hash order that changes with the round) and its members in
other components are compared with the hubs alone; candidates whose signatures agree too little are dropped, the
rest are checked on their shingles, and links join components. A bucket whose members are in one component is
closed: more links in it change nothing. What is open after ``rounds`` rounds is finished exactly: each member
outside its bucket's leading component is compared with the members of other components there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import darts
from .common import by_merge, cut, cut_counted, cut_small, fresh, release, rows_of

CACHE = 200_000
BATCH_SHINGLES = 60_000
BLOCK = 256
#: Open buckets of at most so many members, hence of a bounded number of pairs, are finished pair by pair.
FEW = 12
#: Up to so many links (16 bytes each) are joined on the driver, more by rounds of shuffled joins: each round's queries cost it more memory than these.
LINKS = 100_000


@dataclass(frozen=True)
class DedupParams:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 40
    rows: int = 6
    #: "set": each distinct shingle weighs 1 (Jaccard); "count": its number in the text (weighted Jaccard).
    weights: str = "set"
    #: Estimates this far below the similarity are dropped: five standard errors of 240 coordinates.
    slack: float = 0.13
    rounds: int = 2
    hubs_per_node: int = 3

    @property
    def k(self) -> int:
        return self.bands * self.rows


_words: dict[bytes, int] = {}


def _word(w: bytes) -> int:
    if len(_words) >= CACHE:
        _words.clear()
    h = _words[w] = xxhash.xxh64_intdigest(w)
    return h


def shingles(text: str, size: int) -> np.ndarray:
    """64-bit hashes of the ``size``-word windows in order; a shorter text is one shingle, one without words none."""
    words = text.encode().split()
    if not words:
        return np.empty(0, np.uint64)
    get = _words.get
    h = np.fromiter([get(w) or _word(w) for w in words], np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(size, len(h))):
            out = darts.mix(out * darts.K1 + h[i : i + n])
    return out


def _weighted(text: str, p: DedupParams) -> tuple[np.ndarray, np.ndarray | None]:
    if p.weights == "set":
        return np.unique(shingles(text, p.shingle)), None
    e, c = np.unique(shingles(text, p.shingle), return_counts=True)
    return e, c.astype(np.float64)


def _signed(texts: list[str], p: DedupParams) -> Iterator[tuple[int, np.ndarray]]:
    """(number of distinct shingles, signature or None) of each text, in batches of bounded size."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < BATCH_SHINGLES):
            part.append(_weighted(texts[at], p))
            size += len(part[-1][0])
            at += 1
        full = [x for x in part if len(x[0])]
        sig = iter(())
        if full:
            e = np.concatenate([x[0] for x in full])
            s = np.repeat(np.arange(len(full)), [len(x[0]) for x in full])
            w = None if p.weights == "set" else np.concatenate([x[1] for x in full])
            sig = iter(darts.signatures(e, s, w, len(full), p.k))
        for x in part:
            yield len(x[0]), next(sig) if len(x[0]) else None


def band_keys(sig: np.ndarray, p: DedupParams) -> np.ndarray:
    """A 64-bit key of each band, which holds the band's number."""
    s = sig.reshape(p.bands, p.rows)
    key = np.arange(1, p.bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(p.rows):
            key = darts.mix(key * darts.K1 + s[:, i])
    return key.view(np.int64)


def signed_nodes(docs: DataFrame, p: DedupParams) -> DataFrame:
    """node, doc (least doc_id), n, bands, sig (a byte of each coordinate) of each distinct non-null text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = list(_signed(b["text"].tolist(), p))
            yield pd.DataFrame({
                "node": b["node"].tolist(),
                "doc": b["doc"].tolist(),
                "n": [n for n, _ in rows],
                "bands": [None if s is None else band_keys(s, p) for _, s in rows],
                "sig": [None if s is None else (s & np.uint64(255)).astype(np.uint8).tobytes() for _, s in rows],
            })

    rows = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("node"), F.col("doc_id").cast("string").alias("doc"), "text")
    # Ids pass as strings, as a column of integers and nulls would become one of floats.
    out = rows.mapInPandas(run, "node bigint, doc string, n int, bands array<bigint>, sig binary").withColumn("doc", F.col("doc").cast(kind))
    return out.groupBy("node").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("n", "bands", "sig")])


def estimated(pairs: DataFrame, nodes: DataFrame, p: DedupParams) -> DataFrame:
    """Pairs (a, b, ca, cb) with est, less those whose sizes or signatures rule the similarity out."""
    side = lambda x: by_merge(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    if p.weights == "set":
        rows = rows.where(F.least("n_a", "n_b") >= p.similarity * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = lambda c: np.frombuffer(b"".join(b[c]), np.uint8).reshape(len(b), -1)  # noqa: B023, E731
            est = ((of("sig_a") == of("sig_b")).mean(axis=1) - 1 / 256) / (1 - 1 / 256) if len(b) else np.empty(0)
            keep = est >= p.similarity - p.slack
            yield b.loc[keep, ["a", "b", "ca", "cb"]].assign(est=est[keep])

    return rows.select("a", "b", "ca", "cb", "sig_a", "sig_b").mapInPandas(run, "a bigint, b bigint, ca bigint, cb bigint, est double")


def stored_shingles(docs: DataFrame, wanted: DataFrame, p: DedupParams) -> DataFrame:
    """node and its sorted shingles (32 bits each, enough to tell them apart within a pair) of the ``wanted`` (node, doc)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                e, w = _weighted(t, p)
                e = (e >> np.uint64(32)).astype(np.uint32)
                if w is None:
                    out.append(np.unique(e).tobytes())
                else:
                    o = np.argsort(e, kind="stable")
                    out.append(e[o].tobytes() + w[o].astype(np.uint32).tobytes())
            yield pd.DataFrame({"node": b["node"].tolist(), "s": out})

    rows = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("node"), F.col("doc_id").alias("doc"), "text")
    want = wanted.select(F.col("node").alias("w_node"), F.col("doc").alias("w_doc"))
    return rows.join(by_merge(want), (F.col("node") == F.col("w_node")) & F.col("doc").eqNullSafe(F.col("w_doc")), "left_semi").select("node", "text").mapInPandas(run, "node bigint, s binary").dropDuplicates(["node"])


def similarity(x: bytes, y: bytes, weights: str) -> float:
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    if weights == "set":
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / max(1, len(a) + len(b) - both)
    (a, wa), (b, wb) = a.reshape(2, -1), b.reshape(2, -1)
    _, i, j = np.intersect1d(a, b, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum(dtype=np.int64)
    return both / max(1, wa.sum(dtype=np.int64) + wb.sum(dtype=np.int64) - both)


def checked(pairs: DataFrame, stored: DataFrame, p: DedupParams) -> DataFrame:
    """The components (a, b) of the pairs (a, b, ca, cb) whose shingles have the similarity."""
    side = lambda x: by_merge(stored.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = np.array([similarity(x, y, p.weights) >= p.similarity for x, y in zip(b["s_a"], b["s_b"], strict=True)], bool)
            yield pd.DataFrame({"a": b["ca"].to_numpy()[keep], "b": b["cb"].to_numpy()[keep]})

    return pairs.select("a", "b", "ca", "cb").join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a bigint, b bigint")


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) and the least node that links reach from each: roots hook to lesser ones, pointers jump."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
        while (label != label[label]).any():
            label = label[label]
    return nodes, nodes[label]


def counted_links(links: DataFrame) -> tuple[DataFrame, int]:
    """The distinct ``links`` (a, b) of two nodes each, a less than b, materialised, and their number."""
    return cut_counted(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def components(links: DataFrame, n: int | None = None) -> DataFrame:
    """node, comp (the least node that links reach) of every node of ``links`` (a, b), on the driver where links are counted
    few; else least labels spread and pointers jump by joins. ``n``: their number, where ``counted_links`` gave them."""
    if n is None:
        links, n = counted_links(links)
    if n <= LINKS:
        few = links.toArrow()
        node, comp = least_labels(few["a"].to_numpy(), few["b"].to_numpy())
        return links.sparkSession.createDataFrame(pa.table({"node": node, "comp": comp}), "node bigint, comp bigint")
    ends = links.union(links.select("b", "a"))
    labels = cut_small(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).select("node", F.least("node", "comp").alias("comp")))
    while True:
        near = ends.join(by_merge(labels), F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        new = labels.join(by_merge(near), F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "near").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = cut_small(new.join(by_merge(far), "next", "left").select("node", "comp", F.least("next", F.coalesce("far", "next")).alias("new")))
        labels = new.select("node", F.col("new").alias("comp"))
        if not rows_of(new.where("new <> comp")):
            return labels


def pairs_of(here: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components (ca, cb) within small open buckets, of which one at least is outside ``top``."""
    left = here.where("comp <> top").select("band", F.col("node").alias("x"), F.col("comp").alias("cx"))
    right = here.select("band", F.col("node").alias("y"), F.col("comp").alias("cy"), "top")
    pairs = left.join(by_merge(right), "band").where("cx <> cy and (cy = top or x < y)")
    least, greatest = (lambda x, y, c, f=f: f(x, y).alias(c) for f in (F.least, F.greatest))
    return pairs.select(least("x", "y", "a"), greatest("x", "y", "b"), least("cx", "cy", "ca"), greatest("cx", "cy", "cb")).distinct()


def rest_of_buckets(here: DataFrame, nodes: DataFrame, stored: DataFrame, p: DedupParams) -> DataFrame:
    """Links (a, b) of the components of members in the open buckets ``here`` (band, node, comp, top).

    Every member outside its bucket's leading component ``top`` is compared with every member of another
    component, in blocks of about ``BLOCK`` members, one (block, block) pair a row, so that what is compared is
    never expanded. Nodes that share several buckets are compared in the first of their common bands alone.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    sizes = here.groupBy("band").agg(blocks(F.count("*")).alias("ys"), blocks(F.count_if(F.col("comp") != F.col("top"))).alias("xs"))
    rows = here.join(by_merge(sizes), "band").join(by_merge(nodes.select("node", "bands", "sig")), "node").join(by_merge(stored), "node")
    layout = "band bigint, block int, others int, node binary, comp binary, top bigint, bands binary, sig binary, sizes binary, s binary"

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        of = lambda c: part[c].to_numpy(np.int64).tobytes()
        sizes = np.array([len(x) for x in part["s"]], np.int64).tobytes()
        row = [key[0], key[1], int(part["others"].iloc[0]), of("node"), of("comp"), int(part["top"].iloc[0]), np.array(part["bands"].tolist(), np.int64).tobytes(), b"".join(part["sig"]), sizes, b"".join(part["s"])]
        return pd.DataFrame([row], columns=[c.split()[0] for c in layout.split(", ")])

    def side(rows: DataFrame, own: str, other: str, first: str, second: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node", "band"), F.col(own)).cast("int")
        packed = rows.select("band", block.alias("block"), F.col(other).alias("others"), "node", "comp", "top", "bands", "sig", "s").groupBy("band", "block").applyInPandas(pack, layout)
        return packed.select("band", F.col("block").alias(first), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias(second), *[F.col(c).alias(f"{c}_{first}") for c in ("node", "comp", "top", "bands", "sig", "sizes", "s")])

    pairs = side(rows.where("comp <> top"), "xs", "ys", "x", "y").join(by_merge(side(rows, "ys", "xs", "y", "x")), ["band", "x", "y"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                found = list(_links(r, p))
                yield pd.DataFrame({"a": np.array([x for x, _ in found], np.int64), "b": np.array([y for _, y in found], np.int64)})

    return pairs.mapInPandas(run, "a bigint, b bigint").distinct()


def _links(r: dict, p: DedupParams) -> Iterator[tuple[int, int]]:
    """Links of the components in one (block, block) pair."""
    long = lambda c: np.frombuffer(r[c], np.int64)
    xs, ys, cx, cy = long("node_x"), long("node_y"), long("comp_x"), long("comp_y")
    bx, by = long("bands_x").reshape(len(xs), -1), long("bands_y").reshape(len(ys), -1)
    gx, gy = (np.frombuffer(r[c], np.uint8).reshape(n, -1) for c, n in (("sig_x", len(xs)), ("sig_y", len(ys))))
    sx, sy = (np.concatenate([[0], np.cumsum(long(c))]) for c in ("sizes_x", "sizes_y"))
    for i in range(len(xs)):
        other = np.flatnonzero((cy != cx[i]) & ((cy == r["top_x"]) | (ys > xs[i])))
        if not len(other):
            continue
        same = by[other] == bx[i]
        other = other[bx[i][same.argmax(axis=1)] == r["band"]]
        est = ((gy[other] == gx[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256) if len(other) else np.empty(0)
        for j in other[est >= p.similarity - p.slack]:
            if similarity(r["s_x"][sx[i] : sx[i + 1]], r["s_y"][sy[j] : sy[j + 1]], p.weights) >= p.similarity:
                yield (int(cx[i]), int(cy[j]))


def near_duplicate_classes(docs: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """node, doc, class_id, keeper of each distinct non-null text, materialised.

    class_id is the least doc_id of all near copies linked to it, keeper the node of the text that has it (where no
    copy has an id, the least node).
    """
    nodes = cut(signed_nodes(docs, p))
    bands = nodes.where(F.col("sig").isNotNull()).select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    # Members of buckets with two nodes or more; comp is a node's component so far.
    members = cut_small(bands.join(by_merge(shared), "band").select("band", "node", F.col("node").alias("comp")))
    # Only members are compared from here on.
    nearby = cut_small(nodes.join(by_merge(members.select("node").distinct()), "node"))
    stored = None
    for turn in range(p.rounds + 1):
        release(members)
        order = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp")
        lead = members.groupBy("band").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("size")).where("c1 <> c2")
        if turn < p.rounds:
            hub = members.join(by_merge(lead), "band").select("node", "comp", F.explode(F.array("lo", "hi")).alias("hub")).where("hub.comp <> comp")
            # Pairs keep their components, so that links need not look them up again.
            pairs = hub.select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("comp").alias("ca"), F.col("hub.comp").alias("cb")).distinct()
            # The best few hubs of each node, of two per band at most; whatever else its buckets hold is open for the next round.
            best = F.slice(F.sort_array(F.collect_list(F.struct("est", "b", "cb")), False), 1, p.hubs_per_node)
            pairs = estimated(pairs, nearby, p).groupBy("a").agg(F.min("ca").alias("ca"), best.alias("hubs"))
            pairs, n = cut_counted(pairs.select("a", "ca", F.explode("hubs").alias("hub")).select("a", "hub.b", "ca", "hub.cb"))
        else:
            here, n = cut_counted(members.join(by_merge(lead.select("band", F.col("lo.comp").alias("top"), "size")), "band"))
        release(members)
        if not n:
            continue
        if stored is None:
            stored = cut_small(stored_shingles(docs, nearby.select("node", "doc"), p))
            release(stored)
        if turn < p.rounds:
            found = [checked(pairs, stored, p)]
        else:
            few, many = here.where(F.col("size") <= FEW), here.where(F.col("size") > FEW)
            n_many = rows_of(many)
            # Of the two ways only those are planned that have a bucket, and one after the other: a plan of both costs the driver more.
            found = [checked(estimated(pairs_of(few), nearby, p), stored, p)] if n > n_many else []
            if found and n_many:
                found = [cut_small(found[0])]
                release(members)
            found += [rest_of_buckets(many, nearby, stored, p)] if n_many else []
        links, n = counted_links(reduce(DataFrame.union, found))
        if n:
            joined = components(links, n).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
            release(links)
            members = cut_small(members.join(by_merge(joined), "comp", "left").select("band", "node", F.coalesce("new", "comp").alias("comp")))
    comp = members.groupBy("node").agg(F.min("comp").alias("comp"))
    named = nodes.select("node", "doc").join(by_merge(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = F.min(F.struct(F.col("doc").isNull().alias("bare"), "doc", "node"))
    least = named.groupBy("comp").agg(F.min("doc").alias("class_id"), first["node"].alias("keeper"))
    return cut_small(named.join(by_merge(least), "comp").select("node", "doc", "class_id", "keeper"))


def near_duplicates(docs: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """doc_id, class_id of every row of ``docs``.

    Null texts are classes of their own; texts without words are equal only to equal texts. Repeated rows share
    a class. Class ids are doc_ids, so a table whose ids are all null has null classes. Empty input: no rows.
    """
    classes = near_duplicate_classes(docs, p).select("node", "class_id")
    release(classes)  # of all that led to them, before the rows are shuffled
    rows = docs.select("doc_id", F.xxhash64("text").alias("node"), F.col("text").isNull().alias("bare"))
    return rows.join(by_merge(classes), (rows["node"] == classes["node"]) & ~rows["bare"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """One document of each class, with all columns of ``docs``: that whose doc_id names the class. Null texts stay.

    A null doc_id counts as the greatest: a class keeps such a document only where it has no other.
    """
    key, node, doc = fresh(docs, "d_key", "d_node", "d_doc")
    classes = near_duplicate_classes(docs, p).where("node = keeper").select(F.col("node").alias(node), F.col("doc").alias(doc))
    release(classes)
    rows = docs.withColumn(key, F.xxhash64("text"))
    full = rows.where(F.col("text").isNotNull())
    kept = full.join(by_merge(classes), (full[key] == classes[node]) & full["doc_id"].eqNullSafe(classes[doc]), "left_semi").dropDuplicates([key, "doc_id"])
    return kept.unionByName(rows.where(F.col("text").isNull())).select(*docs.columns)
