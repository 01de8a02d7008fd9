"""Alignment of runs: splines between every pair, transfer of ions a run lacks from its best source, metrics of held-out ions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fdr import q_between, storey_q
from ..operators.joins import first_source
from ..operators.lineage import cut
from ..operators.quantification import refined_time
from ..operators.signal import best_spline, smoothing_spline

KEY = ["sequence", "global_mod", "charge"]


def shared_ions(ions: DataFrame) -> DataFrame:
    """target, source, x (source time), y (target time), ion: ions that two runs share; of one source time the one with most intensity.

    ``ions``: run, sequence, global_mod, charge, rt, intensity, one row per ion and run.
    """
    side = lambda r, t, i: ions.select(*KEY, F.col("run").alias(r), F.col("rt").alias(t), F.col("intensity").alias(i))
    both = side("source", "x", "__i").join(side("target", "y", "__j"), KEY).where("source <> target")
    best = F.max_by(F.struct("y", *KEY), F.struct("__i", *KEY)).alias("b")
    return both.groupBy("target", "source", "x").agg(best).select("target", "source", "x", F.col("b.y").alias("y"), *[F.col(f"b.{k}").alias(k) for k in KEY])


def fitted_pairs(shared: DataFrame, missing: DataFrame, lams=tuple(range(1, 201))) -> DataFrame:
    """Per (target, source): r2 and lambda of the best spline, the predicted time of every ion of ``missing`` and of every held-out one.

    Points and predictions of a pair of runs are bounded by the ions of one run. Every fifth point is held out.
    """
    points = shared.select("target", "source", *KEY, "x", F.col("y"), F.lit(False).alias("gone"))
    ask = missing.select("target", "source", *KEY, "x", F.lit(None).cast("double").alias("y"), F.lit(True).alias("gone"))
    schema = "target string, source string, sequence string, global_mod int, charge int, x double, y double, yhat double, r2 double, lambda double, held_out boolean"

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        known = part[~part["gone"]].sort_values("x").drop_duplicates("x")
        x, y = known["x"].to_numpy(float), known["y"].to_numpy(float)
        test = np.arange(len(x)) % 5 == 2
        if test.sum() < 2 or (~test).sum() < 4:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        lam, r2 = best_spline(x[~test], y[~test], x[test], y[test], lams)
        out = pd.concat([known[test], part[part["gone"]]])
        out["yhat"] = smoothing_spline(x[~test], y[~test], lam, out["x"].to_numpy(float))
        return out.assign(r2=r2, held_out=~out["gone"], **{"lambda": lam})[[c.split()[0] for c in schema.split(", ")]]

    return points.union(ask).groupBy("target", "source").applyInPandas(fit, schema)


def align(ions: DataFrame, lams=tuple(range(1, 201))) -> tuple[DataFrame, DataFrame]:
    """(transferred, held_out): ions that a run lacks with the time predicted from the source that fits best (by r2, then name), and
    the predictions of the held-out ions of every pair."""
    ions = cut(ions)
    runs = [r["run"] for r in ions.select("run").distinct().collect()]  # files of one experiment
    absent = ions.select(*KEY).distinct().withColumn("target", F.explode(F.array(*map(F.lit, runs)))).join(ions.select(*KEY, F.col("run").alias("target")), [*KEY, "target"], "left_anti")
    missing = absent.join(ions.select(*KEY, F.col("run").alias("source"), F.col("rt").alias("x")), KEY)
    fitted = cut(fitted_pairs(shared_ions(ions), missing, lams))
    moved = first_source(fitted.where("NOT held_out"), ["target", *KEY], [F.col("r2").desc(), F.col("source")])
    return moved.drop("y", "held_out"), fitted.where("held_out").drop("held_out")


def metrics(held_out: DataFrame, traces: DataFrame) -> DataFrame:
    """Held-out ions with errors before and after refinement by warping, and the traces' distances.

    ``traces``: run, sequence, global_mod, charge, rt array, trace array.
    """
    side = lambda r, p: traces.select(F.col("run").alias(r), *KEY, F.col("rt_trace").alias(f"{p}_rt"), F.col("trace").alias(f"{p}_trace"))
    rows = held_out.join(side("source", "x"), ["source", *KEY]).join(side("target", "y"), ["target", *KEY])
    schema = "target string, source string, sequence string, global_mod int, charge int, y double, yhat double, yhat_refined double, dtw_before double, dtw_after double"

    def run(batches):
        for b in batches:
            got = [refined_time(r.x_rt, r.x_trace, r.y_rt, r.y_trace, r.x) for r in b.itertuples()]
            yield b[["target", "source", *KEY, "y", "yhat"]].assign(yhat_refined=[g[0] for g in got], dtw_before=[g[1] for g in got], dtw_after=[g[2] for g in got])

    return rows.mapInPandas(run, schema)


def hold_out_r2(rows: DataFrame, measured: str, predicted: str, keys: list[str]) -> DataFrame:
    """One row per group: 1 - residual over total sum of squares of held-out values."""
    y, f = F.col(measured), F.col(predicted)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(F.pow(y - f, 2)), F.var_pop(y) * F.count(y))).alias("r2"))


def training_labels(aligned: DataFrame, measured: DataFrame, keys: list[str], mz_cutoff: float = 0.01, quant_cutoff: float = 0.1) -> DataFrame:
    """``aligned`` with ``good``, for the ions that were also measured: whether m/z and quantity of the channel they were identified in
    (heavy for GlobalMod 1, else light) are nearer to the measured ones than these shares of them. Where a measured value is missing there is no row.

    Both sides have ``keys`` and QuantMz_Light, QuantMz_Heavy, Quant_Light, Quant_Heavy; ``aligned`` has GlobalMod. NaN agrees with nothing.
    """
    names = ("QuantMz_Light", "QuantMz_Heavy", "Quant_Light", "Quant_Heavy")
    own = measured.select(*keys, *[F.col(n).cast("double").alias(f"__{n}") for n in names])
    side = lambda p, q: F.when(F.col("GlobalMod") == 1, F.col(f"{p}{q}_Heavy")).otherwise(F.col(f"{p}{q}_Light"))
    met = aligned.join(own, keys).withColumns({"__mz": side("__", "QuantMz"), "__q": side("__", "Quant")}).where("__mz IS NOT NULL AND __q IS NOT NULL")
    near = lambda value, own, cutoff: F.abs(F.col(own) - value.cast("double")) < F.col(own) * cutoff
    good = near(side("", "QuantMz"), "__mz", mz_cutoff) & near(side("", "Quant"), "__q", quant_cutoff)
    known = ~F.isnan("__mz") & ~F.isnan("__q")
    return met.withColumn("good", F.coalesce(good & known, F.lit(False))).select(*aligned.columns, "good")


def alignment_scores(rows: DataFrame, features: list[str], good: Column, row_id: str, trees: int = 8, seed: int = 7) -> DataFrame:
    """row id, score, q_value of transferred ions: boosted trees learn ``good`` (quantities and masses that agree) on one half of the
    rows by hash and score all; q-values come from the scores of rows that are known not to be good."""
    x = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows.withColumn("label", good.cast("double")))
    model = GBTClassifier(maxIter=trees, maxDepth=3, seed=seed).fit(x.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64(row_id), F.lit(2)) == 0)))
    scored = cut(model.transform(x).select(row_id, "label", vector_to_array("probability")[1].alias("score")))
    known = scored.where(F.col("label").isNotNull())
    return q_between(storey_q(known, "score", F.col("label") == 0), scored, "score").select(row_id, "score", "q_value")
