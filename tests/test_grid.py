"""The grid join against plain loops, and what its cells let meet."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from ionloom.operators import quantification
from ionloom.operators.grid import CELLS, WIDE, Axis, grid, grid_join

SF = "/root/testdata/sf0.01"


def _inside(b, p):
    known = lambda *x: all(v is not None and not math.isnan(v) for v in x)
    return all(known(lo, hi, v) and lo <= v <= hi and math.isfinite(v) for lo, hi, v in zip(b[1::2], b[2::2], p[1:], strict=True))


def _axes(log=False, width=None):
    return [Axis(F.col("l0"), F.col("h0"), F.col("x"), width=width), Axis(F.col("l1"), F.col("h1"), F.col("y"), log, width)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("log", [False, True])
def test_pairs_are_those_of_plain_loops(spark, seed, log):
    r = random.Random(seed)
    coordinate = lambda: r.choice([r.uniform(0.1, 50), float(r.randint(1, 50)), r.uniform(0.1, 5)])
    reach = lambda: r.choice([0.0, r.uniform(0, 1), r.uniform(0, 3), 0.25, r.choice([0.001, 40.0, float("inf")])])
    boxes = [(i, *[v for c, w in ((coordinate(), reach()), (coordinate(), reach())) for v in (c - w, c + w)]) for i in range(120)]
    boxes += [(120, None, 3.0, 1.0, 4.0), (121, float("nan"), 9.0, 1.0, 9.0), (122, 9.0, 3.0, 1.0, 9.0), (123, float("-inf"), float("inf"), float("-inf"), float("inf")), (124, 5.0, 5.0, 6.0, 6.0)]
    points = [(i, coordinate(), coordinate()) for i in range(200)] + [(200, None, 1.0), (201, float("nan"), 1.0), (202, 5.0, 6.0), (202, 5.0, 6.0), (203, float("inf"), 2.0)]
    b, p = spark.createDataFrame(boxes, "b int, l0 double, h0 double, l1 double, h1 double"), spark.createDataFrame(points, "p int, x double, y double")
    got = sorted((t.b, t.p) for t in grid_join(b, p, _axes(log), test=None).collect())
    assert got == sorted((u[0], v[0]) for u in boxes for v in points if _inside(u, v))
    fixed = sorted((t.b, t.p) for t in grid_join(b, p, _axes(log, 2.0)).collect())
    assert fixed == got


def test_keys_empty_sides_and_clashes(spark):
    b = spark.createDataFrame([("a", 1, 0.0, 2.0, 0.0, 2.0), (None, 2, 0.0, 2.0, 0.0, 2.0)], "k string, b int, l0 double, h0 double, l1 double, h1 double")
    p = spark.createDataFrame([("a", 1, 1.0, 1.0), ("c", 2, 1.0, 1.0), (None, 3, 1.0, 1.0)], "k string, p int, x double, y double")
    assert [(r.k, r.b, r.p) for r in grid_join(b, p, _axes(), on=["k"]).collect()] == [("a", 1, 1)]
    assert grid_join(b.limit(0), p, _axes(), on=["k"]).count() == 0 and grid_join(b, p.limit(0), _axes(), on=["k"]).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        grid_join(b, p, _axes())


def test_a_minute_dense_in_masses_is_split(spark):
    """All peaks of one minute: with cells of time alone one key would hold them all."""
    p = spark.range(20_000).select(F.col("id").alias("p"), (F.lit(7.0) + F.rand(1) / 10).alias("rt"), (200 + F.rand(2) * 1800).alias("mz"))
    b = spark.range(300).select(F.col("id").alias("ion"), F.lit(7.0).alias("rt0"), (200 + F.rand(3) * 1800).alias("mz0"))
    axes = [Axis(F.col("rt0") - 0.5, F.col("rt0") + 0.5, F.col("rt")), Axis(F.col("mz0") * (1 - 2e-5), F.col("mz0") * (1 + 2e-5), F.col("mz"), log=True)]
    g = grid(b, p, axes)
    cells = g.points.groupBy(*g.keys).count()
    assert cells.count() > 10_000 and cells.agg(F.max("count")).first()[0] < 20
    assert g.points.count() == 20_000 and g.levels == [(0, 0)]
    assert g.boxes.count() <= 300 * (CELLS + 2) ** 2
    plan = grid_join(b, p, axes)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_wide_box_is_not_copied_without_a_bound(spark):
    b = spark.createDataFrame([(i, i / 10, i / 10 + 0.1, 0.0, 1.0) for i in range(100)] + [(100, 0.0, 1e6, 0.0, 1.0)], "b int, l0 double, h0 double, l1 double, h1 double")
    p = spark.range(2000).select(F.col("id").alias("p"), (F.col("id") * 500.0).alias("x"), F.lit(0.5).alias("y"))
    g = grid(b, p, _axes())
    assert len(g.levels) == 2 and g.boxes.where("b = 100").count() <= (2 * CELLS * WIDE + 2) * 2 * (CELLS + 1)
    assert grid_join(b, p, _axes()).where("b = 100").count() == 2000


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")
def test_what_meets_in_cells_is_near_to_what_matches(spark):
    """Pairs of a box and a point that share a cell, against pairs inside, on the driver's tables: windows of time and mass."""
    part, e = spark.read.parquet(f"{SF}/part.parquet"), spark.read.parquet(f"{SF}/events.parquet")
    b = part.select(F.col("p_partkey").alias("ion"), F.col("p_size").cast("double").alias("rt0"), (F.col("p_retailprice") / 10).alias("mz0"))
    p = e.select((F.col("event_id") % 500 / 10).alias("rt"), (F.col("value") * 2).alias("mz"), F.lit(1.0).alias("intensity"))
    axes = [Axis(F.col("rt0") - 2, F.col("rt0") + 2, F.col("rt")), Axis(F.col("mz0") - 0.3, F.col("mz0") + 0.3, F.col("mz"))]
    g = grid(b, p, axes)
    met = g.boxes.join(g.points, g.keys).count()
    matched = grid_join(b, p, axes).count()
    assert matched > 100 and met <= 3 * matched


def test_bands_keep_their_strict_borders(spark):
    ions = spark.createDataFrame([(1, 10.0, 500.0, 1.0)], "ion int, rt0 double, mz0 double, im0 double")
    peaks = spark.createDataFrame([(10.0, 500.0, 1.0, 1.0), (12.0, 500.0, 1.0, 2.0), (11.999, 500.0049, 1.2, 4.0), (10.0, 500.0051, 1.0, 8.0), (8.0, 500.0, 1.0, 16.0), (10.0, 500.0, 1.5, 32.0), (10.0, 500.0, 1.4999, 64.0)], "rt double, mz double, im double, intensity double")
    flat = quantification.band_join(ions, peaks, 2.0, 10.0)
    assert sorted((r.rt, r.mz, r.intensity) for r in flat.collect()) == [(10.0, 500.0, 97.0), (11.999, 500.0049, 4.0)]
    deep = quantification.band_join(ions, peaks, 2.0, 10.0, 0.5)
    assert sorted((r.rt, r.mz, r.intensity) for r in deep.collect()) == [(10.0, 500.0, 65.0), (11.999, 500.0049, 4.0)]
