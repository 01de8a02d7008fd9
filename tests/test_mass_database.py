"""The mass-ordered peptide database: what a search reads, finds and scores."""

import pytest
from pyspark.sql import functions as F

from ionloom.sources import peptide_db


def _files_read(df):
    """(files, folders) that the plan's scan read, from its own counters."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    value = lambda name: leaf.metrics().apply(name).value()
    return value("numFiles"), value("numPartitions")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db"))
    rows = spark.range(5000).select(F.col("id").alias("ID"), F.col("id").alias("PepSequenceID"), (F.lit(300.0) + F.col("id") * 0.37).alias("RealMass"), F.concat(F.lit("PEP"), F.col("id")).alias("Sequence"), F.lit(0).alias("GlobalMod"))
    hot = spark.range(3000).select((F.col("id") + 10_000).alias("ID"), F.col("id").alias("PepSequenceID"), F.lit(777.25).alias("RealMass"), F.concat(F.lit("HOT"), F.col("id")).alias("Sequence"), F.lit(1).alias("GlobalMod"))
    none = spark.createDataFrame([(-1, -1, None, "X", 0), (-2, -2, float("nan"), "Y", 0)], "ID long, PepSequenceID long, RealMass double, Sequence string, GlobalMod int")
    peptide_db.write_by_mass(rows.union(hot).union(none), path)
    return path


def _precursors(spark, masses):
    return spark.createDataFrame([(i, m) for i, m in enumerate(masses)], "spectrum int, mass double")


def test_a_search_reads_the_folders_of_its_precursors(spark, table):
    low, high = F.col("mass") - 0.5, F.col("mass") + 0.5
    every = spark.read.parquet(f"{table}/by_mass")
    files, folders = _files_read(every)
    assert folders > 300
    x = _precursors(spark, [402.0, 402.3, 1504.7])  # the last touches two cells
    got = peptide_db.mass_scan(x, table, low, high)
    some, touched = _files_read(got)
    assert touched == 3 and some <= 6 < files
    assert {int(r.RealMass // 5) for r in got.collect()} == {80, 300, 301}
    assert peptide_db.mass_scan(_precursors(spark, [1.0, None, float("nan"), 9e9]), table, low, high).count() == 0
    wide = peptide_db.mass_scan(_precursors(spark, [777.0]), table, F.lit(float("-inf")), F.lit(float("inf")))
    assert wide.count() == 8000


def test_candidates_are_those_of_plain_loops(spark, table):
    masses = [402.0, 402.3, 777.25, 777.2, None, 1504.7, 2149.9, 5000.0]
    x = _precursors(spark, masses)
    w = F.col("mass") * 1e-3
    got = sorted((r.spectrum, r.ID) for r in peptide_db.mass_candidates(x, table, F.col("mass") - w, F.col("mass") + w).collect())
    rows = [(r.ID, r.RealMass) for r in spark.read.parquet(f"{table}/by_mass").collect()]
    want = sorted((i, k) for i, m in enumerate(masses) if m for k, real in rows if m - m * 1e-3 <= real <= m + m * 1e-3)
    assert got == want and len(got) > 6000


def test_a_hot_mass_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("ID"), F.lit(0).cast("long").alias("PepSequenceID"), F.lit(777.25).alias("RealMass"), F.lit("A").alias("Sequence"), F.lit(0).alias("GlobalMod"))
    peptide_db.write_by_mass(rows, str(tmp_path / "hot"))
    counts = [r["count"] for r in spark.read.parquet(str(tmp_path / "hot/by_mass")).groupBy(F.input_file_name()).count().collect()]
    assert len(counts) > 1 and max(counts) < 4000


def test_an_empty_table_has_no_candidates(spark, tmp_path):
    none = spark.createDataFrame([], "ID long, PepSequenceID long, RealMass double, Sequence string, GlobalMod int")
    peptide_db.write_by_mass(none, str(tmp_path / "none"))
    m = F.col("mass")
    assert peptide_db.mass_candidates(_precursors(spark, [500.0]), str(tmp_path / "none"), m, m).count() == 0


def test_decoys_keep_tags_with_their_residues(spark):
    x = spark.createDataFrame([("AM[ox]K",)], "Sequence string")
    got = {(r.decoy, r.Sequence) for r in peptide_db.with_decoys(x).collect()}
    assert got == {(False, "AM[ox]K"), (True, "KM[ox]A")}
