"""Quality filters of quantified ions: scan times, their differences, global fences, and the chain of a labeling mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import param, target
from .quantiles import exact_quantiles

SCAN_TIME, DEVIATION = 1, 2


def scan_time_defined(quant: DataFrame) -> DataFrame:
    """Ions whose identified channel has a fitted scan time."""
    return quant.where(param(target(F.col("Params_Light"), F.col("Params_Heavy"), F.col("GlobalMod")), SCAN_TIME).isNotNull())


def _ratio(side: str) -> Column:
    sd = param(F.col(f"Params_{side}"), DEVIATION)
    d = F.col(f"Difference_SearchRT_FittedRT_{side}")
    return F.try_divide(F.abs(F.when(~F.isnan(d), d)), F.when(sd > 0, sd))


def well_timed(quant: DataFrame, most: float = 2.0) -> DataFrame:
    """Ions whose identified channel has a scan time and lies under ``most`` deviations from where it was looked for."""
    return scan_time_defined(quant).where(target(_ratio("Light"), _ratio("Heavy"), F.col("GlobalMod")) < most)


def time_difference_filter(quant: DataFrame, side: str, most: float) -> DataFrame:
    """Ions whose channel ``side`` (Light or Heavy) is under ``most`` deviations off; without a deviation an ion goes."""
    if most <= 0:
        raise ValueError("the number of deviations must be positive")
    return quant.where(_ratio(side) < most)


def inside_fences(df: DataFrame, column: str, k: float = 3.0, below: float | None = None, keep_all_if_unknown: bool = False) -> DataFrame:
    """Rows within Tukey's fences of the whole column (bounds included), and under ``below`` if given.

    Quartiles are exact, from counts by value. Where there are none (no known value) all rows stay if asked for, else none.
    """
    q = exact_quantiles(df, [], column, {"__q1": 0.25, "__q3": 0.75}).first()
    if q is None or q["__q1"] is None:
        return df if keep_all_if_unknown else df.where(F.lit(False))
    reach = k * (q["__q3"] - q["__q1"])
    rows = df.where(F.col(column).between(q["__q1"] - reach, q["__q3"] + reach))
    return rows if below is None else rows.where(F.col(column) < below)


def median_normalised(df: DataFrame, a: str, b: str, low: float, high: float) -> DataFrame:
    """Rows whose log2 of (a over its median) over (b over its median) is strictly inside (low, high); medians are exact and of all rows."""
    m = [exact_quantiles(df, [], c, {"m": 0.5}).first() for c in (a, b)]
    if any(x is None or not x["m"] for x in m):
        return df.where(F.lit(False))
    x = F.log2((F.col(a) / m[0]["m"]) / (F.col(b) / m[1]["m"]))
    return df.where((x > low) & (x < high))


#: The channels that each labeling mode filters, in order.
MODES = {"N15Labeling": ("Heavy", "Light"), "N15LabelingOnly": ("Heavy",), "Unlabeled": ("Light",), "Labelshift": ()}


def labeling_chain(quant: DataFrame, mode: str, low: float, high: float) -> DataFrame:
    """The median-normalised filter of apex against quantity for the channels of a mode, one after the other: the second's
    medians are those of what the first leaves."""
    for side in MODES[mode]:
        quant = median_normalised(quant, f"MeasuredApex_{side}", f"Quant_{side}", low, high)
    return quant
