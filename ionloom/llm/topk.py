"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging.

Queries are packed into tiles and candidates into shards, both of bounded size; each (tile, shard) pair is one
matrix product on one core, of which only the k best per query leave. Lists are merged in two levels, first
over groups of shards, then per query. Pairs are made by an equi-join on (tile, shard), so neither side is
broadcast and both may outgrow any executor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 2048
SHARD = 4096
#: Below this the float product of integers is exact.
EXACT = 2**53
MOST_LENGTHS = 10_000


def usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, finite)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of the quantised rows of two matrices, exact: by floats where all sums stay under 2**53.

    Components are floor(1024 * x) without a bound: 1024 * x is exact unless it leaves the range of doubles, and those beyond
    2**53 / 1024 are integers already. A product beyond 64 bits counts as the greatest or least that they hold.
    """
    most = 1024 * ((np.abs(q).max(initial=0) or 1) + 1) * 1024 * ((np.abs(c).max(initial=0) or 1) + 1) * max(1, q.shape[1])
    if most < EXACT:
        return (np.floor(1024 * q) @ np.floor(1024 * c).T).astype(np.int64)
    whole = lambda m: np.array([[math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(c).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(s: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of one query, ties to smaller ids, without the query's own id."""
    free = ids != own
    s, ids = s[free], ids[free]
    if len(s) > k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        at = s >= edge
        s, ids = s[at], ids[at]
    order = np.lexsort((ids, -s))[:k]
    return s[order], ids[order]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, tile: int = TILE, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row by integer inner product.

    Candidates are all rows with another vec_id. Vectors that are null, or hold null or non-finite components,
    take no part; vectors are compared with those of their own length. Repeated rows are candidates each.
    Query rows that share a vec_id are queries each: every one has its own list, also if they are equal. Rows with a null
    vec_id take no part. Equal scores go to the smaller vec_id. Empty input: no rows. Other columns play no part.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("id"), F.size("embedding").alias("d"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
    counts = rows.groupBy("d").agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("m"))
    # One row per vector length: broadcast only where their number is small.
    sizes = counts.select("d", F.ceil(F.col("m") / tile).cast("int").alias("tiles"), F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    sizes = F.broadcast(sizes) if counts.limit(MOST_LENGTHS + 1).count() <= MOST_LENGTHS else sizes
    rows = rows.join(sizes, "d").where("tiles > 0").withColumn("h", F.xxhash64("id", "v"))
    bucket = lambda n: F.pmod(F.col("h"), n).cast("int").alias("b")
    layout = "d int, b int, ids binary, hs binary, ms binary, v binary"

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        of = lambda c: part[c].to_numpy(np.int64).tobytes()
        return pd.DataFrame({"d": [key[0]], "b": [key[1]], "ids": [of("id")], "hs": [of("h")], "ms": [of("m")], "v": [np.array(part["v"].tolist(), np.float64).reshape(len(part), -1).tobytes()]})

    # Equal query rows are asked once and answered as often as they stand.
    query = rows.where("q").groupBy("d", "tiles", "id", "h", "v").agg(F.count("*").alias("m"))
    tiles = query.select("d", bucket(F.col("tiles")), "id", "h", "m", "v").groupBy("d", "b").applyInPandas(pack, layout)
    shards = rows.select("d", bucket(F.col("shards")), "id", "h", F.lit(1).cast("bigint").alias("m"), "v").groupBy("d", "b").applyInPandas(pack, layout)
    left = tiles.join(sizes, "d").select("d", F.col("b").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), *[F.col(c).alias(f"q{c}") for c in ("ids", "hs", "ms", "v")])
    right = shards.join(sizes, "d").select("d", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("b").alias("shard"), "ids", "v")
    pairs = left.join(right, ["d", "tile", "shard"]).select("shard", "qids", "qhs", "qms", "qv", "ids", "v")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids, qids, qhs, qms = (np.frombuffer(x, np.int64) for x in (r.ids, r.qids, r.qhs, r.qms))
                c, q = np.frombuffer(r.v, np.float64).reshape(len(ids), -1), np.frombuffer(r.qv, np.float64).reshape(len(qids), -1)
                for at in range(0, len(qids), 256):
                    s = scores(q[at : at + 256], c)
                    out = [best(s[i], ids, qids[at + i], k) for i in range(len(s))]
                    n = [len(x[0]) for x in out]
                    own = lambda a: np.repeat(a[at : at + 256], n)  # noqa: B023, E731
                    yield pd.DataFrame({"query_id": own(qids), "h": own(qhs), "m": own(qms), "shard": r.shard, "vec_id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[0] for x in out])})

    lists = pairs.mapInPandas(multiply, "query_id bigint, h bigint, m bigint, shard int, vec_id bigint, score bigint")
    cut = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
    merged = cut(lists.withColumn("branch", (F.col("shard") / 32).cast("int")), "query_id", "h", "branch").drop("rank")
    done = cut(merged, "query_id", "h").withColumn("one", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
