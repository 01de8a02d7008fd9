"""Cutting the lineage of iterative plans, dealing rows to tasks, and tables of one run in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; on one machine (tests) one of our own where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="ionloom-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that one run writes and reads again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Tasks that ``dealt`` makes for each core, so that uneven rows even out.
TASKS_PER_CORE = 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by the hash of ``keys`` to as many tasks as the cores can share, for work that is long for its bytes.

    A file of a few MB is read by one task, and small shuffles are put together to few: both go by bytes, not by what a row costs.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *[F.col(k) for k in keys])


#: Rows that a task of ``spread`` gets, so that what it sorts and hashes is bounded whatever the input.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by the hash of ``keys`` to as many tasks as ``rows``, the rows of the largest table of a job, make at ``TASK_ROWS`` each.

    The session's number of shuffle partitions does not grow with the input, so what one task holds would. Tables that are to meet by
    ``keys`` are spread with the same ``rows``; later steps by these keys and others stay where the rows are.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(n, *[F.col(k) for k in keys])
