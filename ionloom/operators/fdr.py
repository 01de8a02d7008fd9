"""Target-decoy statistics. Cumulative results run over ranges of the score, or over bins, which are far fewer than rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bare_sequence
from ..functions.identifiers import logit
from .lineage import cut
from .ordered import running, top_k


#: Parts that rows of one score are dealt to where they join its q-value.
SALTS = 8


def storey_q(df: DataFrame, score: str, decoy: Column, key: list[str] | None = None) -> DataFrame:
    """score, decoys, targets, q_value per distinct score: decoys over targets from the top, made monotone from the bottom.

    Sums and minima run over ranges of the score, so that as many distinct scores as rows do not meet in one task.
    """
    key = key or []
    per = df.groupBy(*key, score).agg(F.count_if(decoy).alias("decoys"), F.count_if(~decoy).alias("targets"))
    down = running(per, key, [F.col(score).desc()], {"__d": ("sum", "decoys"), "__t": ("sum", "targets")})
    down = down.withColumn("__raw", F.col("__d") / F.greatest(F.col("__t"), F.lit(1))).drop("__d", "__t")
    return running(down, key, [F.col(score).asc()], {"q_value": ("min", "__raw")}).drop("__raw")


def q_between(knots: DataFrame, rows: DataFrame, score: str, q: str = "q_value", outside: str = "nearest", on: list[str] | None = None) -> DataFrame:
    """``rows`` with ``q`` at their score: a knot's own value, linear between knots (of equal ``on``), and outside the nearest knot's, or
    with ``outside`` = ``linear`` that of the line through the last two knots (missing for fewer than two)."""
    on = on or []
    k = knots.select(*on, F.col(score).cast("double").alias("__x"), F.struct(F.col(score).cast("double").alias("x"), F.col(q).alias("y")).alias("__k"))
    # Scores are looked up once each, so rows of a common score are not in one range; they join the value back by parts of their own,
    # of which a score has those that its rows are in: a rare score is not copied for all of them.
    x = F.col(score).cast("double")
    # A few columns are enough to deal rows out, and the optimizer's constraints on the sum double with each column in it.
    plain = [F.col(f"`{c}`") for c, kind in rows.dtypes if c not in on and c != score and "<" not in kind][:3] or [x]
    salted = rows.withColumn("__part", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    distinct = salted.groupBy(*on, x.alias("__x")).agg(F.bit_or(F.expr("shiftleft(1, __part)")).alias("__parts"))
    both = k.unionByName(distinct, allowMissingColumns=True).withColumn("__row", F.col("__k").isNull())
    both = running(both, on, [F.col("__x"), F.col("__row")], {"__low": ("last", "__k")})
    both = running(both, on, [F.col("__x").desc(), F.col("__row")], {"__high": ("last", "__k")}).where("__row")
    low, high = F.col("__low"), F.col("__high")
    inside = low["y"] + (high["y"] - low["y"]) * F.try_divide(F.col("__x") - low["x"], high["x"] - low["x"])
    value = F.when(low.isNull(), high["y"]).when(high.isNull() | (low["x"] == high["x"]), low["y"]).otherwise(inside)
    some = F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit(__parts, i) = 1)")
    found = both.select(*[F.col(c).alias(f"__on_{c}") for c in on], F.col("__x").alias("__at"), value.alias("__q"), F.explode(some).alias("__salt"))
    met = salted.join(found, [x.eqNullSafe(F.col("__at")), F.col("__part") == F.col("__salt"), *[F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on]], "left")
    out = met.select(*[F.col(f"`{c}`") for c in rows.columns if c != q], F.col("__q").alias(q))
    return out if outside == "nearest" else _beyond(k, out, score, q, on)


def _beyond(knots: DataFrame, rows: DataFrame, score: str, q: str, on: list[str]) -> DataFrame:
    """``rows`` with the values outside the knots replaced by lines through the two lowest and the two highest knots of their ``on``."""
    ends = None
    for name, order in (("__first", F.col("__x").asc()), ("__last", F.col("__x").desc())):
        two = top_k(knots, on, [order], 2) if on else knots.orderBy(order).limit(2)
        two = two.groupBy(*[F.col(c).alias(f"__{name}_{c}") for c in on]).agg(F.array_sort(F.collect_list("__k")).alias(name))
        ends = (rows if ends is None else ends).join(F.broadcast(two), [F.col(c).eqNullSafe(F.col(f"__{name}_{c}")) for c in on] or [F.lit(True)], "left")
    x = F.col(score).cast("double")

    def line(name: str) -> Column:
        a, b = F.get(name, F.lit(0)), F.get(name, F.lit(1))
        return a["y"] + (x - a["x"]) * F.try_divide(b["y"] - a["y"], b["x"] - a["x"])

    edge = lambda name, i: F.get(name, F.lit(i))["x"]
    value = F.when(F.size("__first") < 2, F.lit(None)).when(x < edge("__first", 0), line("__first")).when(x > edge("__last", 1), line("__last")).otherwise(F.col(q))
    return ends.withColumn(q, value).select(*rows.columns)


def digested_scores(reversed_peptides: DataFrame, scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """protein, decoy_score: sums of the scores of a protein's reversed peptides that were found, proteins without one left out.

    ``reversed_peptides``: protein, peptide, a row for each time it is cut; ``scores``: sequence, score (per ``keys``, if given). Where
    sequences are alike but for their modifications the last by name counts, with its best score if it has several rows.
    """
    keys = keys or []
    last = F.max(F.struct("sequence", "score"))["score"].alias("score")
    # Dealt by peptide once, for the best scores and for the join.
    bare = scores.select(*keys, bare_sequence(F.col("sequence")).alias("peptide"), "sequence", "score").repartition("peptide").groupBy(*keys, "peptide").agg(last)
    return reversed_peptides.join(bare, "peptide").groupBy(*keys, "protein").agg(F.sum("score").alias("decoy_score")).where("decoy_score <> 0")


def peptide_scores(psms: DataFrame, sequence: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """sequence, score: the best of each peptide (per ``keys``, if given)."""
    return psms.groupBy(*(keys or []), F.col(sequence).alias("sequence")).agg(F.max(score).alias("score"))


def scored_groups(groups: DataFrame, scores: DataFrame, decoys: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``groups`` (protein_group and peptides, both ``;``-joined) with target_score, decoy_score and decoy_bigger.

    The target score sums the best scores of the group's peptides, each of which must have one; the decoy score is the greatest of its
    members', 0 without one. Of equal scores the target wins. With ``keys`` (files) groups, scores and decoys are those of a key.
    """
    keys = keys or []
    g, on = groups.withColumn("__g", F.col("protein_group")), [*keys, "__g"]
    own = g.select(*on, F.explode(F.array_distinct(F.split("peptides", ";"))).alias("sequence")).join(scores, [*keys, "sequence"], "left")
    known = F.when(F.count_if(F.col("score").isNull()) == 0, F.sum("score")).otherwise(F.raise_error(F.concat(F.lit("no score for a peptide of "), F.first("__g"))).cast("double"))
    target = own.groupBy(*on).agg(known.alias("target_score"))
    worst = g.select(*on, F.explode(F.split("protein_group", ";")).alias("protein")).join(decoys, [*keys, "protein"], "left").groupBy(*on).agg(F.max(F.coalesce("decoy_score", F.lit(0.0))).alias("decoy_score"))
    return g.join(target, on).join(worst, on).drop("__g").withColumn("decoy_bigger", F.col("decoy_score") > F.col("target_score"))


def with_decoy_scores(groups: DataFrame, decoys: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``groups`` (a row each: keys, protein_group, target_score and other short columns) with decoy_score and decoy_bigger, as ``scored_groups``.

    The columns of a group go with its members, so that no group is looked up again; lists are better left out.
    """
    keys = keys or []
    members = groups.withColumn("protein", F.explode(F.split("protein_group", ";"))).join(decoys, [*keys, "protein"], "left")
    worst = members.groupBy(*groups.columns).agg(F.max(F.coalesce("decoy_score", F.lit(0.0))).alias("decoy_score"))
    return worst.withColumn("decoy_bigger", F.col("decoy_score") > F.col("target_score"))


def with_decoy_only(scored: DataFrame, decoys: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``scored`` (as from ``scored_groups``) with ``decoy``, and a row for each decoy protein that is in no group of its ``keys``:
    target score 0, its own decoy score, class Unknown, no peptides, ``decoy`` and ``decoy_bigger`` true.

    ``decoys``: keys, protein, decoy_score. Groups and decoys meet by a full outer join on (keys, protein), null-safe in the keys;
    members without a decoy and decoys in several groups do not multiply rows, as only those of one side alone are kept.
    """
    keys = keys or []
    held = scored.select(*[F.col(k).alias(f"__{k}") for k in keys], F.explode(F.split("protein_group", ";")).alias("__protein")).distinct().withColumn("__held", F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("protein") == F.col("__protein")]
    alone = decoys.join(held, same, "full_outer").where("__held IS NULL")
    none = {"protein_group": F.col("protein"), "class": F.lit("Unknown"), "peptides": F.lit(""), "target_score": F.lit(0.0), "decoy_bigger": F.lit(True)}
    rows = cut(alone.select(*keys, *[none[c].alias(c) for c in none if c in scored.columns], F.col("decoy_score").cast("double").alias("decoy_score"), F.lit(True).alias("decoy")))
    return scored.withColumn("decoy", F.lit(False)).unionByName(rows, allowMissingColumns=True)


def group_q_values(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``scored`` (as from ``with_decoy_only``) with ``q_value``, per ``keys``: knots are the decoy score of rows whose decoy is bigger, as
    decoys, and the target score of the others; a row is read at its target score, a decoy-only one at its decoy score."""
    keys = keys or []
    knot = F.when(F.col("decoy_bigger"), F.col("decoy_score")).otherwise(F.col("target_score"))
    knots = storey_q(scored.select(*keys, knot.alias("__score"), "decoy_bigger"), "__score", F.col("decoy_bigger"), keys)
    rows = scored.withColumn("__score", F.when(F.col("decoy"), F.col("decoy_score")).otherwise(F.col("target_score")))
    return q_between(knots, rows, "__score", outside="linear", on=keys).drop("__score")


def logit_pep(bins: DataFrame, score: str, pep: str, widths: list[float]) -> DataFrame:
    """width, slope, intercept, error of the line through the logits of posterior errors, for every bandwidth of ``widths``.

    Rows at 0 and 1 have no logit; only falling lines count. The first row by error is the fit.
    """
    wide = bins.select(F.col(score).cast("double").alias("x"), F.col(pep).alias("p"), F.explode(F.array(*map(F.lit, widths))).alias("width"))
    cells = wide.groupBy("width", F.floor(F.col("x") / F.col("width")).alias("cell")).agg(F.avg("x").alias("x"), logit(F.avg("p")).alias("y")).where("y IS NOT NULL")
    fit = cells.groupBy("width").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.sqrt(F.greatest(F.lit(0.0), F.regr_syy("y", "x") - F.try_divide(F.pow(F.regr_sxy("y", "x"), 2), F.regr_sxx("y", "x"))) / F.count("*")).alias("error"))
    return fit.where("slope < 0").orderBy("error", "width")


def isotonic_pep(bins: DataFrame, score: str, pep: str, weight: str) -> DataFrame:
    """``bins`` with ``fitted``: posterior errors made falling in the score by weighted isotonic regression."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol="__f", labelCol=pep, weightCol="__w", predictionCol="fitted", isotonic=False)
    rows = bins.withColumn("__f", F.col(score).cast("double")).withColumn("__w", F.col(weight).cast("double"))
    return model.fit(rows).transform(rows).drop("__f", "__w")


def spline_basis(x: Column, knots: list[float]) -> list[Column]:
    """The natural cubic spline basis of ``len(knots)`` knots less its constant: x, then cubic pieces that are straight beyond the knots."""
    cube = lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3.0))
    last = knots[-1]
    piece = lambda k: (cube(k) - cube(last)) / (last - k)
    return [x, *[piece(k) - piece(knots[-2]) for k in knots[:-2]]]


def irls_pep(rows: DataFrame, score: str, decoy: Column, out: str, knots: int = 5) -> DataFrame:
    """``rows`` with ``out``, the posterior error at their score: the odds of a decoy by logistic regression on a natural cubic spline of
    the score, fitted by iteratively reweighted least squares (Kall, Storey and Noble 2008), 1 at most.

    Scores are standardised and the knots are quantiles, so the fit sees as many numbers a row as there are knots. Fewer than three
    distinct knots leave a straight line; only decoys give 1, only targets 0, and a missing score a missing error.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    s = F.col(score).cast("double")
    some = s.isNotNull() & ~F.isnan(s)
    at = rows.where(some).agg(F.count("*").alias("n"), F.count_if(decoy).alias("d"), F.avg(s).alias("m"), F.stddev_pop(s).alias("sd"), F.percentile_approx(s, [(i + 0.5) / knots for i in range(knots)], 1000).alias("k")).first()
    if not at["d"] or at["d"] == at["n"]:
        return rows.withColumn(out, F.when(some, 1.0 if at["d"] else 0.0))
    x = (s - at["m"]) / (at["sd"] or 1.0)
    places = sorted({(k - at["m"]) / (at["sd"] or 1.0) for k in at["k"]})
    basis = spline_basis(x, places) if len(places) > 2 else [x]
    names = [f"__b{i}" for i in range(len(basis))]
    own = rows.where(some).select(decoy.cast("double").alias("label"), *[b.alias(n) for b, n in zip(basis, names, strict=True)])
    fit = GeneralizedLinearRegression(family="binomial", link="logit", regParam=1e-6, maxIter=25).fit(VectorAssembler(inputCols=names, outputCol="features").transform(own))
    logit_of = sum((b * float(c) for b, c in zip(basis, fit.coefficients, strict=True)), F.lit(float(fit.intercept)))
    return rows.withColumn(out, F.when(some, F.least(F.lit(1.0), F.exp(F.least(logit_of, F.lit(50.0))))))


def logistic_curve(rows: DataFrame, score: str, label: Column) -> tuple[float, float]:
    """(intercept, slope) of the univariate logistic regression of a 0/1 label on a score."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=["__s"], outputCol="features", handleInvalid="skip").transform(rows.select(F.col(score).cast("double").alias("__s"), label.cast("double").alias("label")))
    model = LogisticRegression(regParam=0.0, standardization=True, maxIter=100, tol=1e-10).fit(x)
    return float(model.intercept), float(model.coefficients[0])


def q_values(df: DataFrame, score: str, decoy: Column, method: str | None, width: float | None = None, fdr: float = 1.0) -> DataFrame:
    """``df`` with ``q_value`` by method: ``storey``, ``logistic`` (scaled by an overall rate) or None (missing).

    A fit that fails gives missing values, as nothing better is known.
    """
    if method == "storey":
        return q_between(storey_q(df, score, decoy), df, score)
    if method == "logistic":
        top, slope, middle = logistic_q(binned_pep(df, score, decoy, width or 1.0, fdr))
        curve = top / (1 + F.exp(slope * (F.col(score).cast("double") - middle))) if top == top else F.lit(None).cast("double")
        return df.withColumn("q_value", curve)
    if method is None:
        return df.withColumn("q_value", F.lit(None).cast("double"))
    raise ValueError(method)


def binned_pep(df: DataFrame, score: str, decoy: Column, width: float, pi0: float = 1.0) -> DataFrame:
    """Per score bin: mean score, scaled posterior error, and q from the sums over this bin and all above."""
    bins = df.groupBy(F.floor(F.col(score) / width).alias("bin")).agg(F.avg(score).alias("mean_score"), F.count_if(decoy).alias("decoys"), F.count("*").alias("n"))
    total = bins.agg(F.sum("decoys").alias("__all_d"), F.sum("n").alias("__all_n"))
    rows = running(bins, [], [F.col("bin").desc()], {"__d": ("sum", "decoys"), "__n": ("sum", "n")}).crossJoin(F.broadcast(total))
    scale = F.try_divide(F.lit(1.0), 2 * F.col("__all_d") / F.col("__all_n"))
    pep = scale * pi0 * 2 * F.col("decoys") / F.col("n")
    q = scale * pi0 * 2 * F.col("__d") / F.col("__n")
    return rows.withColumn("pep", pep).withColumn("q_value", q).select(*bins.columns, "pep", "q_value")


def decoy_ratio(df: DataFrame, decoy: Column, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.count_if(decoy), F.count_if(~decoy)).alias("fdr"))


def hypergeometric_expectation(targets: int, decoys: int, total: int) -> float:
    """Expected false positives among ``targets`` when ``decoys`` hits fall on ``total`` entries by chance."""
    if total <= 0 or targets <= 0:
        return 0.0
    logs = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    most = min(targets, decoys)
    w = np.array([logs(total - targets + f, f) + logs(targets - f, decoys - f) if 0 <= decoys - f <= targets - f else -np.inf for f in range(most + 1)])
    if not np.isfinite(w).any():
        return 0.0
    p = np.exp(w - w[np.isfinite(w)].max())
    return float((p * np.arange(most + 1)).sum() / p.sum())


def mayu_fdr(df: DataFrame, length: str, decoy: Column, found: Column, chunks: int = 10) -> float:
    """Entries in length chunks, expected false hits of each by the hypergeometric law, summed over all targets found.

    The counts that reach the driver are three per chunk.
    """
    from .ordered import equal_chunks

    sized = equal_chunks(df, [], [F.col(length), F.col("id")], chunks, "chunk")
    rows = sized.groupBy("chunk").agg(F.count("*").alias("n"), F.count_if(found & ~decoy).alias("t"), F.count_if(found & decoy).alias("d")).collect()
    targets = sum(r["t"] for r in rows)
    fdr = sum(hypergeometric_expectation(r["t"], r["d"], r["n"]) for r in rows) / targets if targets else 1.0
    return fdr if 0 < fdr <= 1 else 1.0


def logistic_q(bins: DataFrame, score: str = "mean_score", q: str = "q_value") -> tuple[float, float, float]:
    """Logistic curve through the q-values of score bins (see ``binned_pep``): only bins reach the driver."""
    from .signal import logistic_fit

    rows = bins.select(score, q).where(F.col(q).isNotNull()).orderBy(score).collect()
    if len(rows) < 3:
        return (float("nan"),) * 3
    return logistic_fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
