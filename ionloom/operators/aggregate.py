"""Key-reducing grouped aggregation with row and group filters, and the hierarchical roll-ups built from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, inverse, transform
from .quantiles import exact_quantiles

#: Aggregates that a shuffle combines; ``median`` is the one besides, see ``grouped_values``.
AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class GroupFilter:
    """``tukey`` and ``stdev`` take a factor, ``topx`` a number of values."""

    kind: str
    arg: float


@dataclass(frozen=True)
class Channel:
    """A quantity: its column, a transform, scalar bounds and group filters, and how groups are aggregated."""

    column: str
    transform: str = "identity"
    above: float | None = None
    below: float | None = None
    group_filters: tuple[GroupFilter, ...] = ()
    agg: str = "mean"
    #: The number that arithmetic transforms add, subtract, multiply or divide by.
    operand: float = 0.0


def with_stats(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``stats``, which has one row per group (null keys included)."""
    side = stats.withColumnsRenamed({k: f"__g_{k}" for k in keys})
    if not keys:
        return df.crossJoin(F.broadcast(side))
    return df.join(side, [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys], "left").drop(*[f"__g_{k}" for k in keys])


def grouped_values(df: DataFrame, keys: list[str], values: dict[str, tuple[str, str]], also: list[Column] | None = None) -> DataFrame:
    """One row per group: ``values`` maps a column to (aggregate, column of ``df``); ``also`` are further aggregates.

    A median by Spark's own function would hold all distinct values of its group in one buffer, so medians are ``exact_quantiles``,
    joined to the groups; the other aggregates are one shuffle.
    """
    plain = [AGGREGATES[f](c).alias(n) for n, (f, c) in values.items() if f != "median"]
    out = df.groupBy(*keys).agg(*(plain + (also or []) or [F.count("*").alias("__n")]))
    rest = [c for c in out.columns if c not in {*keys, *values, "__n"}]
    for n, (f, c) in values.items():
        if f == "median":
            out = with_stats(out, exact_quantiles(df, keys, c, {n: 0.5}), keys)
    return out.select(*keys, *values, *rest)


def group_filter(df: DataFrame, value: str, f: GroupFilter, keys: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: whether a row's value passes the filter of its group. Missing values are no part of a group.

    The bounds of each group are aggregated first and joined, so a hot group is never one window.
    """
    v = F.col(value)
    if f.kind == "tukey":
        fences = exact_quantiles(df, keys, value, {"__q1": 0.25, "__q3": 0.75})
        reach = f.arg * (F.col("__q3") - F.col("__q1"))
        bounds = fences.select(*keys, (F.col("__q1") - reach).alias("__low"), (F.col("__q3") + reach).alias("__high"))
    elif f.kind == "stdev":
        sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
        bounds = df.groupBy(*keys).agg((F.avg(value) - f.arg * sd).alias("__low"), (F.avg(value) + f.arg * sd).alias("__high"))
    elif f.kind == "topx":
        # The x-th greatest value: what ties with it stays. Limits are applied before the shuffle.
        w = Window.partitionBy(*keys).orderBy(v.desc())
        top = df.where(v.isNotNull()).select(*keys, value).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= int(f.arg))
        bounds = top.groupBy(*keys).agg(F.min(value).alias("__low"), F.lit(float("inf")).alias("__high"))
    else:
        raise ValueError(f.kind)
    return with_stats(df, bounds, keys).withColumn(out, v.between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


def filtered(df: DataFrame, channel: Channel, keys: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: the transformed value where every filter passes, else missing.

    Group filters see the transformed, unfiltered column; a value survives if all pass.
    """
    df, passes = tested(df.withColumn(out, transform(F.col(channel.column), channel.transform, channel.operand)), channel, keys, out)
    return df.withColumn(out, F.when(F.col(passes), F.col(out))).drop(passes)


def tested(df: DataFrame, channel: Channel, keys: list[str], value: str) -> tuple[DataFrame, str]:
    """``df`` with a column that says whether ``value`` is known and passes the channel's bounds and group filters, and its name."""
    tests = [F.col(value).isNotNull()]
    if channel.above is not None:
        tests.append(F.col(value) > channel.above)
    if channel.below is not None:
        tests.append(F.col(value) < channel.below)
    names = [f"{value}__{i}" for i in range(len(channel.group_filters))]
    for f, n in zip(channel.group_filters, names, strict=True):
        df = group_filter(df, value, f, keys, n)
    out = f"{value}__passes"
    return df.withColumn(out, F.coalesce(all_of([*tests, *[F.col(n) for n in names]]), F.lit(False))).drop(*names), out


def aggregate(df: DataFrame, keys: list[str], channels: dict[str, Channel], also: list[Column] | None = None) -> DataFrame:
    """One row per group with a surviving value: each channel's aggregate under its name."""
    for name, c in channels.items():
        df = filtered(df, c, keys, f"__{name}")
    out = grouped_values(df, keys, {name: (c.agg, f"__{name}") for name, c in channels.items()}, also)
    return out.where(F.coalesce(*channels).isNotNull())


def dispersion(value: str, out: str) -> list[Column]:
    """n, mean, cv, sd and sem of the known values of a column."""
    n, m, sd = F.count(value), F.avg(value), F.stddev_samp(value)
    return [n.alias(f"n_{out}"), m.alias(f"mean_{out}"), F.try_divide(sd, m).alias(f"cv_{out}"), sd.alias(f"sd_{out}"), (sd / F.sqrt(n)).alias(f"sem_{out}")]


def tukey_aggregate(df: DataFrame, keys: list[str], column: str, k: float, scale: str, agg: str, out: str) -> DataFrame:
    """Aggregate after dropping what lies outside Tukey fences on a transformed scale."""
    kept = filtered(df, Channel(column, scale, group_filters=(GroupFilter("tukey", k),)), keys, "__v")
    return grouped_values(kept.withColumn("__v", inverse(F.col("__v"), scale)), keys, {out: (agg, "__v")})


def roll_up(df: DataFrame, levels: list[list[str]], channels: dict[str, Channel]) -> DataFrame:
    """Chained aggregation: each level's key list is a subset of the one before; later levels aggregate aggregates."""
    step = channels
    for keys in levels:
        df = aggregate(df, keys, step)
        step = {n: Channel(n, agg=c.agg) for n, c in step.items()}
    return df


def first_known(c: str) -> Column:
    return F.first(F.when(~F.isnan(c), F.col(c)), ignorenulls=True)


def pivot_runs(df: DataFrame, key: list[str], run: str, runs: list[str], values: list[str], between: str = "_") -> DataFrame:
    """One column per (run, value), runs given in order so that no extra pass looks for them."""
    return df.groupBy(*key).agg(*[F.first(F.when(F.col(run) == r, F.col(v)), ignorenulls=True).alias(f"{r}{between}{v}") for r in runs for v in values])


def histogram(df: DataFrame, score: str, width: float, decoy: Column) -> DataFrame:
    """Fixed-width bins: centre, entries, decoys and the median score."""
    if width <= 0:
        raise ValueError("the bin width must be positive")
    rows = df.select(F.floor(F.col(score) / width).alias("bin"), F.col(score).alias("__s"), decoy.alias("__d"))
    out = grouped_values(rows, ["bin"], {"median_score": ("median", "__s")}, [F.count("*").alias("n"), F.count_if("__d").alias("decoys")])
    return out.withColumn("centre", F.col("bin") * width + width / 2)


def kernel_bandwidth(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """One row per group: 0.9 * min(standard deviation, interquartile range / 1.34) * n ** -0.2 (Silverman's rule)."""
    per = df.groupBy(*keys).agg(F.stddev_samp(value).alias("__sd"), F.count("*").cast("double").alias("__n"))
    per = with_stats(per, exact_quantiles(df, keys, value, {"__q1": 0.25, "__q3": 0.75}), keys)
    return per.select(*keys, (0.9 * F.least(F.col("__sd"), (F.col("__q3") - F.col("__q1")) / 1.34) * F.pow("__n", F.lit(-0.2))).alias(out))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def confusion(df: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn and accuracy, precision, recall and F1 of each group; what has no denominator is missing."""
    counts = {"tp": truth & predicted, "fp": ~truth & predicted, "fn": truth & ~predicted, "tn": ~truth & ~predicted}
    out = df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    tp, fp, fn, tn = (F.col(n) for n in counts)
    return out.withColumns({"accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)})
