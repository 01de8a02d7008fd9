"""Files of runs: discovery, pairing by stem, spectra by extension (mzML or Parquet), retention-time index and binned sinks."""

from __future__ import annotations

import base64
import html
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Terms of mzML that a reader needs.
MS_LEVEL, SCAN_START, ION_MZ, ZLIB, MZ_ARRAY, INTENSITY_ARRAY, FLOAT_64 = "MS:1000511", "MS:1000016", "MS:1000744", "MS:1000574", "MS:1000514", "MS:1000515", "MS:1000523"
#: Fixed value: the unit of scan times given in seconds.
SECONDS = "UO:0000010"
SPECTRA = "id string, ms_level int, rt double, precursor_mz double, peaks array<struct<mz:double,intensity:double>>"


def find_files(spark: SparkSession, paths: Iterable[str], extension: str) -> list[str]:
    """Files among ``paths``, and files of the extension (of any case) in those that are folders; what is neither gives none.

    Paths are opened by Hadoop's file systems, so any store that Spark reads will do.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: dict[str, None] = {}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            continue
        if fs.getFileStatus(path).isFile():
            out[p] = None
            continue
        names = sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isFile())
        out |= dict.fromkeys(n for n in names if n.lower().endswith("." + extension.lower().lstrip(".")))
    return list(out)


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])


def pair_files(left: Iterable[str], right: Iterable[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """(pairs of equal stem, files without a partner)."""
    a, b = {stem(p): p for p in left}, {stem(p): p for p in right}
    pairs = [(a[s], b[s]) for s in a if s in b]
    return pairs, [p for s, p in [*a.items(), *b.items()] if (s in a) != (s in b)]


def spectrum_head(xml: str) -> tuple | None:
    """(id, ms_level, rt in minutes, precursor m/z) of one spectrum element; no peak is decoded."""
    if (head := re.match(r'[^>]*?\bid="([^"]*)"', xml)) is None:
        return None
    terms = {m[1]: m[0] for m in re.finditer(r'<cvParam\b[^>]*?accession="([^"]+)"[^>]*>', xml.split("<binaryDataArrayList", 1)[0])}
    value = lambda t: float(re.search(r'value="([^"]*)"', terms[t])[1]) if t in terms else None
    rt = value(SCAN_START)
    if rt is not None and SECONDS in terms[SCAN_START]:
        rt /= 60
    level = value(MS_LEVEL)
    return html.unescape(head[1]), None if level is None else int(level), rt, value(ION_MZ)


def spectrum_peaks(xml: str) -> list[dict[str, float]]:
    """The peaks of one spectrum element."""
    found: dict[str, np.ndarray] = {}
    for part in re.findall(r"<binaryDataArray\b.*?</binaryDataArray>", xml, re.S):
        raw = base64.b64decode(re.search(r"<binary>(.*?)</binary>|<binary\s*/>", part, re.S)[1] or "")
        if ZLIB in part and raw:
            raw = zlib.decompress(raw)
        found["mz" if MZ_ARRAY in part else "i" if INTENSITY_ARRAY in part else "other"] = np.frombuffer(raw, "<f8" if FLOAT_64 in part else "<f4").astype(float)
    mz, it = found.get("mz", np.empty(0)), found.get("i", np.empty(0))
    return [{"mz": a, "intensity": b} for a, b in zip(mz.tolist(), it.tolist(), strict=True)]


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """id, ms_level, rt (minutes), precursor_mz, peaks of every spectrum. A file is split at its spectra, so that large files have many tasks."""
    rows = spark.read.option("lineSep", "<spectrum ").text(path).where(F.contains("value", F.lit("</spectrum>")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [v.split("</spectrum>", 1)[0] for v in b["value"]]
            got = [(*head, spectrum_peaks(x)) for x in own if (head := spectrum_head(x)) is not None]
            yield pd.DataFrame(got, columns=["id", "ms_level", "rt", "precursor_mz", "peaks"])

    return rows.mapInPandas(run, SPECTRA)


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of a file or folder by its extension: ``.mzML``, or Parquet of the same columns. Others are an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "mzml":
        return read_mzml(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for spectra of kind {kind!r}")


def unzipped(peaks: Column) -> tuple[Column, Column]:
    """The m/z and the intensity array of peaks."""
    return F.transform(peaks, lambda p: p["mz"]), F.transform(peaks, lambda p: p["intensity"])


def peaks_of(spectra: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """id, mz, intensity of the wanted spectra; ids that no spectrum has are left out."""
    mz, it = unzipped(F.col("peaks"))
    return spectra.join(wanted.select(F.col(key).alias("id")).distinct(), "id", "left_semi").select("id", mz.alias("mz"), it.alias("intensity"))


def level_filter(spectra: DataFrame, levels: tuple[int, ...] = (1, 2)) -> DataFrame:
    return spectra.where(F.col("ms_level").isin(*levels))


def time_filter(spectra: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Spectra strictly inside an open or closed retention-time window."""
    if start is not None:
        spectra = spectra.where(F.col("rt") > start)
    return spectra if end is None else spectra.where(F.col("rt") < end)


def time_index(spectra: DataFrame, width: float) -> DataFrame:
    """MS1 spectra by retention-time bucket: bucket, first and last time, and their ids in order. A bucket's size is bounded by ``width``."""
    ms1 = level_filter(spectra, (1,)).where("rt is not null")
    per = ms1.groupBy(F.floor(F.col("rt") / width).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("rt", "id"))).alias("s"))
    return per.select("bucket", F.col("s")[0]["rt"].alias("first_rt"), F.element_at("s", -1)["rt"].alias("last_rt"), F.col("s.id").alias("ids"))


def write_binned(spectra: DataFrame, column: str, width: float, path: str, mode: str = "errorifexists") -> None:
    """One folder per bin of ``column`` (ion mobility, say); rows are dealt by bin and time, so that a hot bin has many files."""
    binned = spectra.withColumn("bin", F.floor(F.col(column) / width))
    binned.repartition("bin", F.floor("rt")).write.mode(mode).partitionBy("bin").parquet(path)


def empty_table(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """A table with columns only: what a tool writes whose model cannot be fitted."""
    return spark.createDataFrame([], schema)


def write_rows(df: DataFrame, path: str, append: bool = False) -> None:
    """Tab-separated rows, each part with the header; ``append`` adds to what is there, otherwise it is replaced."""
    df.write.mode("append" if append else "overwrite").option("sep", "\t").option("header", True).csv(path)
