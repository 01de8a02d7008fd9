"""Sources and sinks: typed tab-separated tables, FASTA, GFF3, parameter files, and their writers."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType


def number_list(c: Column) -> Column:
    """``[|a;b|]``, ``"a;b"`` or ``a;b`` as an array of doubles; an empty cell is an empty array, a bad number null."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r'[|\[\]" ]', "")
    return F.when(bare == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(bare, ";"), lambda x: x.try_cast("double")))


def read_table(spark: SparkSession, path: str | list[str], schema: StructType, fill: bool = True, file_column: str | None = None) -> DataFrame:
    """Tab-separated files with a header, bound by column name; NaN and empty cells are missing.

    Columns of ``schema`` that older files lack are null with ``fill``; without it they are an error. Every
    cell is read as text and cast by the plan, so only the columns that a query uses are parsed.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    names = {c.strip('"'): c for c in raw.columns}
    missing = [f.name for f in schema if f.name not in names]
    if missing and not fill:
        raise ValueError(f"{path} lacks {missing}")

    def typed(f) -> Column:
        if f.name not in names:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{names[f.name]}`")
        if isinstance(f.dataType, ArrayType):
            return number_list(c).alias(f.name)
        text = F.trim(F.regexp_replace(c, '^"|"$', ""))
        if isinstance(f.dataType, StringType):
            return text.alias(f.name)
        value = text.try_cast(f.dataType)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            value = F.when(~F.isnan(value), value)
        elif isinstance(f.dataType, (IntegerType, LongType)):
            value = F.coalesce(value, text.try_cast("double").cast(f.dataType))
        return value.alias(f.name)

    extra = [F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1).alias(file_column)] if file_column else []
    return raw.select(*extra, *[typed(f) for f in schema])


def read_frame(spark: SparkSession, path: str | list[str], types: dict[str, str] | None = None, infer: bool = True) -> DataFrame:
    """A tab-separated table with whatever columns its header names. Columns in ``types`` have that type; the others are inferred from
    all rows, or stay text without ``infer``. Empty cells and NaN are missing."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', inferSchema=infer, nullValue="", nanValue="NaN")
    cols = []
    for f in raw.schema:
        c = F.col(f"`{f.name}`")
        kind = (types or {}).get(f.name)
        if kind is not None:
            c = c.cast("string").try_cast(kind)
        number = kind in ("double", "float") or kind is None and isinstance(f.dataType, (DoubleType, FloatType))
        text = kind is None and isinstance(f.dataType, StringType) or kind == "string"
        cols.append((F.when(~F.isnan(c), c) if number else F.when(c != "NaN", c) if text else c).alias(f.name))
    return raw.select(*cols)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, sequence of each entry; a closing ``*`` and line breaks are dropped."""
    entry = F.regexp_replace("value", "^>", "")
    rows = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "")
    return rows.select(F.trim(F.regexp_extract(entry, r"^([^\r\n]*)", 1)).alias("header"), F.regexp_replace(F.regexp_replace(entry, r"^[^\r\n]*", ""), r"[\s*]+", "").alias("sequence"))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns of annotation rows, attributes as a map."""
    names = "seqid source feature start end score strand phase attributes".split()
    rows = spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"`{n}` string" for n in names))
    return rows.select("seqid", "source", "feature", F.col("start").try_cast("int").alias("start"), F.col("end").try_cast("int").alias("end"), F.col("score").try_cast("double").alias("score"), "strand", "phase", F.str_to_map("attributes", F.lit(";"), F.lit("=")).alias("attributes"))


def plain_params(value: Any) -> Any:
    """Tagged unions of a parameter file (``Case``, ``Fields``) as (case, fields) or the bare case; ``Some`` is its value."""
    if isinstance(value, dict) and "Case" in value:
        fields = [plain_params(f) for f in value.get("Fields", [])]
        if value["Case"] == "Some":
            return fields[0]
        return (value["Case"], *fields) if fields else value["Case"]
    if isinstance(value, dict):
        return {k: plain_params(v) for k, v in value.items()}
    return [plain_params(v) for v in value] if isinstance(value, list) else value


def read_params(path: str) -> dict:
    with open(path, encoding="utf-8-sig") as f:
        return plain_params(json.load(f))


def write_table(df: DataFrame, path: str, missing: str = "NaN", mode: str = "errorifexists") -> None:
    """Tab-separated with header; arrays joined by ``;``, missing numbers written as ``missing``."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ";", missing)
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.coalesce(c.cast("string"), F.lit(missing))
        cols.append(c.alias(f.name))
    df.select(*cols).write.mode(mode).csv(path, sep="\t", header=True)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested rows as JSON lines."""
    df.write.mode(mode).json(path)


def write_spectra(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Spectra of MS levels 1 and 2 that have peaks, one folder per level; any other level is an error."""
    checked = df.where(F.size("peaks") > 0).withColumn("ms_level", F.when(F.col("ms_level").isin(1, 2), F.col("ms_level")).otherwise(F.raise_error(F.concat(F.lit("MS level "), F.col("ms_level").cast("string")))))
    checked.write.mode(mode).partitionBy("ms_level").parquet(path)


def to_minutes(time: Column, unit: Column) -> Column:
    return F.when(unit == "second", time / 60).when(unit == "minute", time).when(unit == "hour", time * 60).otherwise(F.raise_error(F.concat(F.lit("time unit "), unit)).cast("double"))
