"""Quantification tables that arrive as files: the same roll-up as a stream, one micro-batch per set of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Tab-separated files of a folder as they appear."""
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Rows and sums per event-time window and key; data later than ``late`` behind is dropped by the watermark."""
    w = F.window(time, width).alias("window")
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
