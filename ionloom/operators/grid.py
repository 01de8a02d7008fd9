"""Joins of boxes with points in several dimensions (time, mass, mobility ...) by an equi-join on the cells of a grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that a box of median extent is long on each axis, give or take its place: more cells test fewer points and copy boxes more often.
CELLS = 2
#: Boxes over so many times the median extent use a grid of wider cells, so that no box is copied without a bound.
WIDE = 4
#: Steps of an octave in which extents are counted.
STEPS = 4


@dataclass(frozen=True)
class Axis:
    """One dimension: a box holds the points whose ``value`` lies in [``low``, ``high``]. With ``log`` (values above 0) cells are equal
    on a logarithmic scale, as for windows that are relative to a mass. ``width`` is the cells' width on that scale, else the data's."""

    low: Column
    high: Column
    value: Column
    log: bool = False
    width: float | None = None


@dataclass(frozen=True)
class Grid:
    """Both sides of a grid join before they meet: boxes once for each cell they touch, points once for each grid in use."""

    boxes: DataFrame
    points: DataFrame
    keys: list[str]
    widths: list[float]
    levels: list[tuple[int, ...]]


def _known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def grid(boxes: DataFrame, points: DataFrame, axes: list[Axis], on: list[str] | None = None) -> Grid:
    """Cells of boxes and points. Missing and NaN bounds and values are in no cell; open bounds end at the points' range.

    The driver sees the points' range and the numbers of boxes by extent, in quarters of an octave: a bounded table.
    """
    both = (set(boxes.columns) & set(points.columns)) - set(on or [])
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    n = range(len(axes))
    scaled = lambda a, c: F.ln(c) if a.log else c
    p = points.withColumns({f"__v{i}": a.value.cast("double") for i, a in enumerate(axes)})
    for i, a in enumerate(axes):
        p = p.where(_known(F.col(f"__v{i}")) & (F.col(f"__v{i}") > (F.lit(0.0) if a.log else F.lit(float("-inf")))) & (F.col(f"__v{i}") < float("inf")))
    ends = p.agg(*[f(f"__v{i}").alias(f"{x}{i}") for i in n for x, f in (("a", F.min), ("z", F.max))]).first()
    b = boxes.withColumns({f"__{x}{i}": c.cast("double") for i, a in enumerate(axes) for x, c in (("l", a.low), ("h", a.high))})
    for i in n:
        b = b.where(_known(F.col(f"__l{i}")) & _known(F.col(f"__h{i}")))
    cut = {f"__{x}{i}": f(F.col(f"__{x}{i}"), F.lit(ends[f"{e}{i}"]).cast("double")) for i in n for x, f, e in (("l", F.greatest, "a"), ("h", F.least, "z"))}
    b = b.withColumns(cut)
    for i in n:
        b = b.where(F.col(f"__l{i}") <= F.col(f"__h{i}"))
    extent = [scaled(a, F.col(f"__h{i}")) - scaled(a, F.col(f"__l{i}")) for i, a in enumerate(axes)]
    step = [F.when(e > 0, F.ceil(STEPS * F.log2(e))).cast("int").alias(f"e{i}") for i, e in enumerate(extent)]
    seen = [tuple(r) for r in b.groupBy(*step).count().collect()]
    widths = [a.width or _width([(r[i], r[-1]) for r in seen if r[i] is not None]) for i, a in enumerate(axes)]
    level = lambda i, e: F.when(e > 0, F.greatest(F.lit(0), F.ceil(F.log2(e / (widths[i] * CELLS * WIDE))))).otherwise(0).cast("int")
    b = b.withColumns({f"__k{i}": level(i, e) for i, e in enumerate(extent)})
    # Extents that are counted alike may differ by a level, so levels are read off the boxes themselves where some box is wide.
    wide = any(r[i] is not None and 2.0 ** (r[i] / STEPS) > widths[i] * CELLS * WIDE for r in seen for i in n)
    levels = sorted(tuple(r) for r in b.select(*[f"__k{i}" for i in n]).distinct().collect()) if wide else [(0,) * len(axes)]
    if wide:
        every = F.array(*[F.struct(*[F.lit(k).alias(f"__k{i}") for i, k in enumerate(ks)]) for ks in levels])
        p = p.withColumn("__k", F.explode(every)).select("*", "__k.*").drop("__k")
    else:
        p = p.withColumns({f"__k{i}": F.lit(0) for i in n})
    at = lambda i, a, c: F.floor(scaled(a, c) / (widths[i] * F.pow(F.lit(2.0), F.col(f"__k{i}")))).cast("bigint")
    p = p.withColumns({f"__c{i}": at(i, a, F.col(f"__v{i}")) for i, a in enumerate(axes)})
    for i, a in enumerate(axes):
        b = b.withColumn(f"__c{i}", F.explode(F.sequence(at(i, a, F.col(f"__l{i}")), at(i, a, F.col(f"__h{i}")))))
    keys = [*(on or []), *[f"__c{i}" for i in n], *([f"__k{i}" for i in n] if wide else [])]
    drop = [] if wide else [f"__k{i}" for i in n]
    return Grid(b.drop(*drop), p.drop(*drop), keys, widths, levels)


def _width(extents: list[tuple[int, int]]) -> float:
    """Cells of which the median extent is ``CELLS`` long; 1 where all boxes are points."""
    total, below = sum(n for _, n in extents), 0
    for e, n in sorted(extents):
        below += n
        if 2 * below >= total:
            return 2.0 ** (e / STEPS) / CELLS
    return 1.0


def grid_join(boxes: DataFrame, points: DataFrame, axes: list[Axis], on: list[str] | None = None, test: Column | None = None) -> DataFrame:
    """Every box with every point inside it on all ``axes`` (and of equal ``on``): columns of both.

    Boxes and points meet by an equi-join on their cells of all axes at once, so a minute that is dense in masses is as many
    keys as it has mass cells; each point stands once, or once per grid where some boxes are far wider than most. ``test``
    replaces the exact test of the bounds (which then only have to cover it); it is part of the join's condition, so that pairs
    that only share a cell never leave the join. Skewed cells are split by Spark's skew join; it is a merge join whatever the session's
    threshold, as the bytes of a file say little about the rows that it has for each cell.
    """
    g = grid(boxes, points, axes, on)
    inside = test
    if inside is None:
        inside = F.lit(True)
        for i in range(len(axes)):
            inside = inside & F.col(f"__v{i}").between(F.col(f"__l{i}"), F.col(f"__h{i}"))
    return g.boxes.join(g.points.hint("merge"), g.keys).where(inside).select(*boxes.columns, *[c for c in points.columns if c not in (on or [])])
