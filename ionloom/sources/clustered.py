"""Spectra clustered by run and time, with a manifest of each file's bounds, from which a scan picks its files before it is planned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file string, run string, low double, high double, spectra bigint"


def write_clustered(spectra: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """``spectra`` (run, rt and what else they have) under ``path``/spectra in ranges of (run, rt), and their bounds under ``path``/manifest.

    ``files`` is about their number (the session's shuffle partitions). Spectra without a time are in a file of their own range,
    with no bounds. The manifest has a row per file and run, and is made from the files themselves.
    """
    spark = spectra.sparkSession
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("run"), F.col("rt").asc_nulls_first()]
    spectra.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode(mode).parquet(f"{path}/spectra")
    there = spark.read.parquet(f"{path}/spectra")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
    bounds = there.groupBy(name, F.col("run").cast("string").alias("run")).agg(F.min("rt").cast("double").alias("low"), F.max("rt").cast("double").alias("high"), F.count("*").alias("spectra"))
    bounds.coalesce(1).write.mode(mode).parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, run, low, high, spectra: the bounds of each file's times of each run."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str, wanted: Column) -> DataFrame:
    names = sorted({r["file"] for r in manifest(spark, path).where(wanted).select("file").distinct().collect()})
    whole = spark.read.parquet(f"{path}/spectra")  # for the columns; its files are not opened
    return spark.read.schema(whole.schema).parquet(*[f"{path}/spectra/{n}" for n in names]) if names else whole.limit(0)


def read_window(spark: SparkSession, path: str, run: str, low: float, high: float) -> DataFrame:
    """The spectra of a run with ``low`` <= rt <= ``high``, from the files alone whose bounds meet the window."""
    wanted = (F.col("run") == run) & (F.col("low") <= high) & (F.col("high") >= low)
    return _files(spark, path, wanted).where((F.col("run") == run) & F.col("rt").between(low, high))


def _of_windows(spark: SparkSession, path: str, windows: DataFrame, width: float) -> DataFrame:
    """The spectra of the files that some window needs.

    Files are found by a join of the manifest, which is small, with the windows' distinct cells of ``width``; what the driver holds is the
    names of files.
    """
    at = lambda c: F.floor(F.col(c) / width).cast("bigint")
    cells = windows.where("low <= high").select(F.col("run").cast("string").alias("run"), F.explode(F.sequence(at("low"), at("high"))).alias("cell")).distinct()
    files = manifest(spark, path).where("low IS NOT NULL").select("file", "run", F.explode(F.sequence(at("low"), at("high"))).alias("cell"))
    names = sorted({r["file"] for r in files.join(cells, ["run", "cell"], "left_semi").select("file").distinct().collect()})
    return _files(spark, path, F.col("file").isin(names) if names else F.lit(False))


def read_windows(spark: SparkSession, path: str, windows: DataFrame, width: float) -> DataFrame:
    """Each window (its columns, with run, low and high) with the spectra of its run and time, from the files that some window needs.

    Windows and spectra meet by run and time cell of ``width``. The result has a row for each pair; ``window_totals`` makes none.
    """
    from ..operators.joins import range_join

    return range_join(windows, _of_windows(spark, path, windows, width), F.col("low"), F.col("high"), F.col("rt"), width, on=["run"])


def window_totals(spark: SparkSession, path: str, windows: DataFrame, width: float, count: str, results: dict[str, tuple[str, str]]) -> DataFrame:
    """The windows (with run, low and high) that hold a spectrum of their run and time, with the number of these spectra and ``results`` of
    their columns, from the files that some window needs; see ``operators.joins.window_totals``."""
    from ..operators.joins import window_totals as totals

    return totals(windows, _of_windows(spark, path, windows, width), ["run"], "low", "high", "rt", count, results)
