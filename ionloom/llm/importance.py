"""Target-distribution importance resampling: hashed n-gram features, log-ratio weights, Gumbel top draws.

Equal texts are collapsed first, by grouping whole texts; the buckets of a distinct text's features are
computed once and kept, packed, beside its multiplicity. Bucket counts of the corpus are sums over distinct
texts times multiplicity; counts of both corpora are as many numbers as there are buckets, so the gains
are a list that every task can hold. Weights are then sums of gains over the packed buckets and join back to the
documents by the SHA-256 of the text. A text of a large share of all documents is one key of that join; such
texts (``HOT`` of them at most, by their multiplicity) are dealt by a salt.

Noise is a hash of the document's id. Ranks come from ranges of the score, in order, and the rows of each range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: A text with more than 1 / HOT of all documents is joined by a salt; there are fewer than HOT of them.
HOT = 1000
SALTS = 64


@dataclass(frozen=True)
class ImportanceParams:
    buckets: int = 10_000
    #: Features are runs of one to so many words.
    longest: int = 3
    #: Added to the count of each bucket, and so ``buckets`` times to the total.
    prior: int = 1
    #: Documents of fewer words are weighed but not drawn.
    min_words: int = 20
    percent: int = 5
    seed: str = "42"


#: Bytes of a text to those of its words: A-Z become a-z, what is no part of a word becomes a space; all bytes of other characters stay.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, as UTF-8; null has none."""
    return text.encode().translate(TO_WORDS).split(b" ") if text else []


def features(text: str | None, p: ImportanceParams) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each feature (crc32 of its bytes, continued from that of the feature one word shorter)."""
    w = [x for x in words(text) if x]
    crc, tails, out = [*map(zlib.crc32, w)], [b" " + x for x in w], []
    for n in range(1, p.longest + 1):
        out.append(np.array(crc, np.uint32) % np.uint32(p.buckets))
        crc = [*map(zlib.crc32, tails[n:], crc)]
    return len(w), np.concatenate(out)


def pack(buckets: np.ndarray) -> bytes:
    """Buckets in order, as compressed differences: about a byte a feature."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(np.sort(buckets), prepend=np.uint32(0)).astype("<u4").tobytes())


def unpack(packed: bytes) -> np.ndarray:
    """Buckets of ``pack``, in order."""
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u4"))


def collapsed(docs: DataFrame, p: ImportanceParams) -> DataFrame:
    """Distinct texts: their SHA-256, multiplicity, numbers of words and features, and packed buckets. Nulls are one text without words."""
    texts = docs.groupBy(F.col("text").alias("t")).agg(F.count("*").alias("times"))
    rows = texts.select(F.coalesce(F.unhex(F.sha2("t", 256)), F.lit(b"")).alias("digest"), "times", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                made = [(n, len(x), pack(x)) for n, x in (features(t.as_py(), p) for t in b.column(2))]
                n, k, packed = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(packed, pa.binary())], ["digest", "times", "n_words", "n_features", "packed"])

    return rows.mapInArrow(run, "digest binary, times bigint, n_words bigint, n_features bigint, packed binary")


def counts(texts: DataFrame, p: ImportanceParams) -> np.ndarray:
    """Features in each bucket over all documents: per task the counts of its texts times their multiplicity, then sums by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for b in batches:
            for times, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total += times * np.bincount(unpack(packed.as_py()), minlength=p.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = texts.select("times", "packed").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(p.buckets, np.int64)
    for r in found:  # one row per bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, p: ImportanceParams) -> np.ndarray:
    """Of each bucket the log ratio of its shares in target and source, in thousandths, downwards."""
    more = p.buckets * p.prior
    all_s, all_t = float(int(source.sum()) + more), float(int(target.sum()) + more)
    return np.array([math.floor(1000 * math.log((float(t + p.prior) * all_s) / (float(s + p.prior) * all_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(texts: DataFrame, of_bucket: np.ndarray) -> DataFrame:
    """Distinct texts with the sum of their features' gains (no feature: 0)."""
    shared = texts.sparkSession.sparkContext.broadcast(of_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            sums = [int(gain[unpack(x.as_py())].sum()) for x in b.column(4)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(sums, pa.int64())], ["digest", "times", "n_words", "n_features", "weight"])

    return texts.mapInArrow(run, "digest binary, times bigint, n_words bigint, n_features bigint, weight bigint")


def joined_back(docs: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """Documents (id alone) with their text's numbers. Keys of more than 1 / HOT of all documents are dealt to ``SALTS`` tasks."""
    hot = texts.where(F.col("times") * HOT > total)
    salts = F.when(F.col("times") * HOT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = texts.select("digest", F.explode(salts).alias("salt"), "n_words", "n_features", "weight")
    left = docs.select("i", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("digest"))
    left = left.join(F.broadcast(hot.select("digest", F.lit(True).alias("hot"))), "digest", "left")  # under HOT rows
    left = left.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")).otherwise(0))
    return left.join(right, ["digest", "salt"]).select("i", "n_words", "n_features", "weight")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, downwards, of the id's hash; null ids have that of an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, p: ImportanceParams = ImportanceParams(), id_col: str = "doc_id") -> DataFrame:
    """Every document's id, n_features, weight, score, and rank among the drawn ones (not drawn: null).

    ``target`` has a column ``text``. Drawn are the ``percent`` of documents of at least ``min_words`` words with the highest scores,
    rounded down, ties to smaller ids (null ids last; rows of one id have ranks of their own). Null and empty texts have no features
    and weight 0, as have all texts where neither table has features. Repeated rows count and are ranked as often as they stand; other
    columns of either table play no part; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("i"), "text")
    texts = cut(collapsed(docs, p))
    size = texts.agg(F.sum("times").alias("n"), F.sum(F.when(F.col("n_words") >= p.min_words, F.col("times"))).alias("able")).first()
    drawn = p.percent * (size["able"] or 0) // 100
    gain = gains(counts(texts, p), counts(collapsed(target.select("text"), p), p), p)
    rows = joined_back(docs, weighed(texts, gain), size["n"] or 0)
    rows = cut(rows.withColumn("score", F.col("weight") + noise(F.col("i"), p.seed)))
    return ranked(rows, F.col("n_words") >= p.min_words, drawn).select(F.col("i").alias(id_col), "n_features", "weight", "score", "rank")


def ranked(rows: DataFrame, able: Column, drawn: int) -> DataFrame:
    """``rows``, materialised ones, with the ``rank`` (from 1) of the first ``drawn`` of the ``able`` ones by score, then id.

    Ranges of (score, id, row) are sorted apart; a range's first rank is the number of rows in the ranges before it.
    """
    row, first, part = fresh(rows, "row", "first", "part")
    order = [F.col("score").desc(), F.col("i").asc_nulls_last(), F.col(row).asc()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.where(able).withColumn(row, F.monotonically_increasing_id())
    some = cut(some.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    some = some.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1})
    sizes = sorted((r[part], r["n"]) for r in some.groupBy(part).agg(F.count("*").alias("n")).collect())  # a row per range
    before, n = [], 0
    for k, size in sizes:
        before.append((k, n))
        n += size
    starts = rows.sparkSession.createDataFrame(before, f"{part} int, {first} bigint")
    some = some.join(F.broadcast(starts), part).withColumn("rank", F.col(first) + F.col(row))
    some = some.select(*rows.columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return some.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("bigint")))
