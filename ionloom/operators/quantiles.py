"""Exact quantiles per group without a group's values in one task: counts by value, running sums over ranges, picks by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group with the quantiles ``shares`` (column: share) of its known values, linear between neighbouring ranks."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("__v")).agg(F.count("*").alias("__n"))
    ranks = running(counts, keys, [F.col("__v")], {"__to": ("sum", "__n")})
    total = counts.groupBy(*[F.col(k).alias(f"__t_{k}") for k in keys]).agg(F.sum("__n").alias("__total"))
    met = ranks.join(total, [F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in keys]) if keys else ranks.crossJoin(F.broadcast(total))
    at = {q: (F.col("__total") - 1) * share for q, share in shares.items()}
    holds = lambda i: (F.col("__to") > i) & (F.col("__to") - F.col("__n") <= i)
    picked = {}
    for q, h in at.items():
        picked[f"__lo_{q}"] = F.max(F.when(holds(F.floor(h)), F.col("__v")))
        picked[f"__hi_{q}"] = F.max(F.when(holds(F.ceil(h)), F.col("__v")))
        picked[f"__f_{q}"] = F.max(h - F.floor(h))
    some = F.lit(False)
    for h in at.values():
        some = some | holds(F.floor(h)) | holds(F.ceil(h))
    out = met.where(some).groupBy(*keys).agg(*[c.alias(n) for n, c in picked.items()])
    return out.select(*keys, *[(F.col(f"__lo_{q}") + (F.col(f"__hi_{q}") - F.col(f"__lo_{q}")) * F.col(f"__f_{q}")).alias(q) for q in shares])
