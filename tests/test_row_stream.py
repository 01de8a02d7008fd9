"""Streamed rows: one header, whole calls or nothing, appended tables."""

import os

import pytest
from pyspark.sql import functions as F

from ionloom.sources.row_stream import read_rows, stream_rows


def _text(path):
    return "".join(open(f"{path}/{n}").read() for n in sorted(os.listdir(path)) if n.startswith("part-"))


def test_many_tasks_write_one_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100, numPartitions=7).select(F.col("id"), (F.col("id") / 3).alias("x"), F.array(F.lit(1.5), F.lit(None).cast("double")).alias("a"), F.when(F.col("id") > 50, F.concat(F.lit("a\tb\n"), F.col("id"))).alias("s"))
    stream_rows(df, path, append=False)
    lines = _text(path).split("\n")
    assert lines[0] == "id\tx\ta\ts" and lines[-1] == "" and len(lines) == 102
    assert [x.split("\t")[0] for x in lines[1:-1]] == [str(i) for i in range(100)]
    assert lines[1] == "0\t0.0\t1.5;NaN\tNaN" and lines[100] == "99\t33.0\t1.5;NaN\ta b 99"
    assert [float(x.split("\t")[1]) for x in lines[1:-1]] == [i / 3 for i in range(100)]
    stream_rows(df.limit(2).coalesce(1), path)
    lines = _text(path).split("\n")
    assert len(lines) == 104 and sum(x.startswith("id\t") for x in lines) == 1
    assert read_rows(spark, path).count() == 102 and read_rows(spark, path).where("id = '99'").first()["x"] == "33.0"
    stream_rows(df.limit(1), path, append=False)
    assert len(_text(path).split("\n")) == 3


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    stream_rows(spark.range(5).select("id"), path)
    before = _text(path)
    bad = spark.range(40, numPartitions=8).select(F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        stream_rows(bad, path)
    assert _text(path) == before and not [n for n in os.listdir(path) if not n.startswith("part-")]


def test_other_columns_are_refused_and_empty_tables_have_a_header(spark, tmp_path):
    path = str(tmp_path / "t")
    stream_rows(spark.range(3).where("id > 9"), path)
    assert _text(path) == "id\n" and read_rows(spark, path).count() == 0
    with pytest.raises(Exception, match="columns"):
        stream_rows(spark.range(3).select(F.col("id").alias("other")), path)
    assert _text(path) == "id\n"
