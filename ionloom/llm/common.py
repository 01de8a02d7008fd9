"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and the five controls from tab to carriage return.
WHITE = " \t\n\x0b\f\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone (any store that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the session runs on one machine a
    folder of our own is taken; on a cluster it would be the driver's alone, so there an unset folder is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="ionloom-"))
    return df.checkpoint(eager=True)


#: A materialised frame keeps about one partition per so many rows, so that small ones do not deal out empty files.
ROWS_PER_PARTITION = 50_000


def rows_of(df: DataFrame) -> int:
    """Rows of a materialised frame, or of a filter over one, by one plain job: a query's plans and shuffles would cost the driver more."""
    return df._jdf.queryExecution().toRdd().count()


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_small`` and the number of rows."""
    df = cut(df)
    n = rows_of(df)
    return df.coalesce(n // ROWS_PER_PARTITION + 1), n


def cut_small(df: DataFrame) -> DataFrame:
    """``cut`` for frames that are often far smaller than the partitions they came from: partitions follow the rows."""
    return cut_counted(df)[0]


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not to be broadcast, whatever its size and the session's threshold: a broadcast is
    collected, hashed and kept by the driver, at several times its size."""
    return df.hint("merge")


def release(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of frames that nothing refers to any more, as it does when the driver collects."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_SPLIT))


def without(text: Column, chars: str) -> Column:
    """The text less every character in ``chars`` (one pass, on the JVM)."""
    return F.translate(text, chars, "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that ``df`` does not use, whatever extra columns it has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
