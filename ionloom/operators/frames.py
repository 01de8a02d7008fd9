"""Frame operators: sparse rows and columns, key columns, renaming, disjoint merges, checked lookups and level aggregates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .aggregate import grouped_values


def _missing(df: DataFrame, c: str) -> Column:
    nan = isinstance(df.schema[c].dataType, (DoubleType, FloatType))
    return F.col(c).isNull() | F.isnan(c) if nan else F.col(c).isNull()


def filter_cells(df: DataFrame, columns: Iterable[str], keep) -> DataFrame:
    """Cells of ``columns`` for which ``keep`` (a function of the column) does not hold become missing."""
    return df.withColumns({c: F.when(keep(F.col(c)), F.col(c)) for c in columns})


def drop_empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value (neither null nor NaN) in one of ``columns`` at least."""
    every = F.lit(True)
    for c in columns:
        every = every & _missing(df, c)
    return df.where(~every)


def drop_sparse_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in every one of ``columns``."""
    some = F.lit(False)
    for c in columns:
        some = some | _missing(df, c)
    return df.where(~some)


def drop_empty_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` without those of ``columns`` that hold no value at all: one pass of counts, one row to the driver."""
    counts = df.agg(*[F.count_if(~_missing(df, c)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not counts[c]])


def renamed_apart(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """``right`` with a suffix on columns that ``left`` also has, keys excepted."""
    return right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns and c not in keys})


def key_column(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """``df`` with a composite key of named columns as text."""
    return df.withColumn(out, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]))


def key_to_columns(df: DataFrame, key: str) -> DataFrame:
    """A composite key spread into columns again, in front of the others."""
    return df.select(f"{key}.*", *[c for c in df.columns if c != key])


def without_keys(keys: list[str], gone: Iterable[str]) -> list[str]:
    return [k for k in keys if k not in set(gone)]


def only_keys(keys: list[str], kept: Iterable[str]) -> list[str]:
    return [k for k in keys if k in set(kept)]


def first_by_value(df: DataFrame, column: str, order: list[Column]) -> DataFrame:
    """The first row of each value of ``column``: a partial minimum, not a window over a hot value."""
    row = F.struct(*[F.struct(*order).alias("o"), F.struct(*[F.col(c) for c in df.columns]).alias("r")])
    return df.groupBy(F.col(column).alias("__k")).agg(F.min(row).alias("m")).select("m.r.*")


def disjoint_union(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both sides; a key that both sides have is an error when the result is read."""
    rows = left.withColumn("__side", F.lit(1)).unionByName(right.withColumn("__side", F.lit(2)), allowMissingColumns=True)
    both = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count_distinct("__side").alias("__n")).where("__n > 1")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = rows.join(both, on, "left")
    clash = F.raise_error(F.concat(F.lit("key on both sides: "), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])).cast("boolean")
    return met.where(F.when(F.col("__n").isNull(), True).otherwise(clash)).select(*[c for c in rows.columns if c != "__side"])


def lookup_or_fail(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the row of ``right`` that has its keys; a key without one is an error when read."""
    side = right.select(*keys, F.struct(*columns).alias("__found"))
    met = left.join(side, keys, "left")
    missing = F.raise_error(F.concat(F.lit("no row for "), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]))
    found = F.when(F.col("__found").isNotNull(), F.col("__found")).otherwise(missing.cast(side.schema["__found"].dataType))
    return met.withColumn("__found", found).select(*left.columns, "__found.*")


def apply_level(df: DataFrame, keys: list[str], columns: list[str], agg: str, other: str, exceptions: Iterable[str]) -> DataFrame:
    """One row per key: ``columns`` by ``agg``, those in ``exceptions`` by ``other``."""
    odd = set(exceptions)
    return grouped_values(df, keys, {c: (other if c in odd else agg, c) for c in columns})


def expand_rows(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """One row per member of a joined cell."""
    return df.withColumn(column, F.explode(F.split(column, separator)))


def from_arrays(df: DataFrame, columns: list[str], at: str | None = None) -> DataFrame:
    """One row per position of array columns of any lengths; shorter ones are filled with nulls."""
    zipped = F.arrays_zip(*columns)
    keep = [c for c in df.columns if c not in columns]
    if at is None:
        return df.select(*keep, F.inline(zipped))
    return df.select(*keep, F.posexplode(zipped).alias(at, "__z")).select(*keep, at, "__z.*")


def prepended(df: DataFrame, columns: list[str], first: dict[str, object]) -> DataFrame:
    """Array columns with a value put in front of each."""
    return df.withColumns({c: F.concat(F.array(F.lit(first[c])), F.col(c)) for c in columns})


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that holds its number of rows (``rows``) once an action has run: no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
