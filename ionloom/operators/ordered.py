"""Ordered and windowed operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Ranges that running results are dealt to at least; the rows that pass between ranges are at most a few for each.
RANGES = 64


def ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` in ranges of (keys, order) with ``__p``, the number of its range; to be materialised before it is read twice.

    A key with a third of all rows is cut into ranges by its order, so that no task holds all of it.
    """
    parts = max(RANGES if df.sparkSession.sparkContext.master[:5] != "local" else 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("__p", F.spark_partition_id())


def running(df: DataFrame, keys: list[str], order: list[Column], results: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running results per key in ``order``, the row itself included: ``results`` maps a new column to (``sum``, ``min``, ``max``
    or ``last``, column). ``last`` is the last value that is not null.

    Each range has its own running result; what a key brings from earlier ranges is found over one row for each (key,
    range) of the keys that span several, which are fewer than the ranges.
    """
    rows = ranged(df, keys, order)
    own = Window.partitionBy("__p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    apply = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    merge = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "min": F.least, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}
    # The running results of a range's last row of a key are the range's totals. Rows are written with them, so that ranges are sorted once.
    last = Window.partitionBy("__p", *keys).orderBy(*order).rowsBetween(1, 1)
    rows = cut(rows.withColumns({f"__{n}": apply[f](c).over(own) for n, (f, c) in results.items()} | {"__more": F.max(F.lit(1)).over(last)}))
    ends = rows.where("__more IS NULL").select(*keys, "__p", *[f"__{n}" for n in results])
    several = ends.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.min("__p").alias("__a"), F.max("__p").alias("__z")).where("__a < __z")
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] or [F.lit(True)]
    ends = cut(ends.join(F.broadcast(several), same).select(*keys, "__p", *[f"__{n}" for n in results]))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__p").alias("__q"), *[apply[f](f"__{n}").over(before).alias(f"__c_{n}") for n, (f, _) in results.items()])
    met = rows.join(F.broadcast(carry), [*same, F.col("__p") == F.col("__q")], "left") if keys else rows.join(F.broadcast(carry), F.col("__p") == F.col("__q"), "left")
    return met.select(*df.columns, *[merge[f](F.col(f"__c_{n}"), F.col(f"__{n}")).alias(n) for n, (f, _) in results.items()])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, number: str | None = None) -> DataFrame:
    """The first k rows of each group; limits before the shuffle where the order allows."""
    out = df.withColumn(number or "__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(number or "__n") <= k)
    return out if number else out.drop("__n")


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Rows counted from 0 within their group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def local_maxima(df: DataFrame, keys: list[str], order: str, value: str, reach: int = 2) -> DataFrame:
    """Rows strictly above ``reach`` neighbours on both sides; rows nearer to a border are none."""
    w = Window.partitionBy(*keys).orderBy(order)
    names = []
    for i in range(1, reach + 1):
        df = df.withColumn(f"__p{i}", F.lag(value, i).over(w)).withColumn(f"__n{i}", F.lead(value, i).over(w))
        names += [f"__p{i}", f"__n{i}"]
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.col(value) > F.col(n))
    return df.where(ok).drop(*names)


def without_dropouts(df: DataFrame, keys: list[str], order: str, value: str, factor: float = 100.0) -> DataFrame:
    """Interior zero points go where the value before is non-zero and over ``factor`` times (value + 1)."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("__p", F.lag(value).over(w)).withColumn("__e", F.lead(order).over(w).isNull())
    gone = (F.col(value) == 0) & F.col("__p").isNotNull() & (F.col("__p") != 0) & (F.col("__p") > factor * (F.col(value) + 1)) & ~F.col("__e")
    return df.where(~F.coalesce(gone, F.lit(False))).drop("__p", "__e")


def group_when(df: DataFrame, keys: list[str], order: str, starts: Column, out: str) -> DataFrame:
    """A segment number that grows at each row where ``starts`` holds."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def equal_chunks(df: DataFrame, keys: list[str], order: list[Column], chunks: int, out: str) -> DataFrame:
    """Sorted rows cut into chunks of ceil(n / chunks), the last ones smaller or missing. Ranks come from running sums over ranges."""
    sizes = df.groupBy(*[F.col(k).alias(f"__s_{k}") for k in keys]).agg(F.count("*").alias("__n"))
    rows = running(df.withColumn("__one", F.lit(1).cast("bigint")), keys, order, {"__r": ("sum", "__one")})
    rows = rows.join(sizes, [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys]) if keys else rows.crossJoin(F.broadcast(sizes))
    chunk = F.floor((F.col("__r") - 1) / F.ceil(F.col("__n") / chunks)).cast("int")
    return rows.withColumn(out, chunk).select(*df.columns, out)
