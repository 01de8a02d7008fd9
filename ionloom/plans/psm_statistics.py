"""PSM statistics: fixed thresholds, or a scorer trained in rounds on its own confident hits, q-values and posterior errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fdr import irls_pep, q_between, storey_q
from ..operators.lineage import cut
from ..sources.runs import empty_table

SCORES = ("SequestScore", "SequestNormDeltaBestToRest", "SequestNormDeltaNext", "AndroScore", "AndroNormDeltaBestToRest", "AndroNormDeltaNext", "XtandemScore", "XtandemNormDeltaBestToRest", "XtandemNormDeltaNext")


@dataclass(frozen=True)
class ScorerParams:
    #: Targets under this q-value by the first score are the positives that the first model learns from.
    first_q: float = 0.001
    #: Thresholds of the result; later positives are under a tenth of ``q``, and under ``pep``.
    q: float = 0.01
    pep: float = 0.05
    max_rounds: int = 15
    #: Rounds end when the hits under both thresholds grow by less than this share.
    min_gain: float = 0.005
    trees: int = 8
    depth: int = 3
    charges: tuple[int, ...] = (2, 3, 4, 5)
    seed: int = 7


@dataclass(frozen=True)
class Round:
    """One trained model: what it learned from, the hits under the thresholds, and what became of it."""

    positives: int
    negatives: int
    hits: int
    outcome: str


def over_thresholds(psms: DataFrame, sequest: float, andromeda: float) -> DataFrame:
    """Hits whose two scores both exceed their thresholds."""
    return psms.where((F.col("SequestScore") > sequest) & (F.col("AndroScore") > andromeda))


def confident(scored: DataFrame, q: float, pep: float) -> DataFrame:
    """Target hits under a q-value and a posterior error."""
    return scored.where((F.col("QValue") < q) & (F.col("PEPValue") < pep) & (F.col("Label") == 1))


def features(psms: DataFrame, p: ScorerParams) -> tuple[DataFrame, list[str]]:
    """``psms`` with a column per charge (one-hot), and the names of all features."""
    hot = {f"charge_{z}": (F.col("Charge") == z).cast("double") for z in p.charges}
    return psms.withColumns(hot), ["PrecursorMZ", "TheoMass", "AbsDeltaMass", "PeptideLength", "MissCleavages", *SCORES, *hot]


#: Adds ``ModelScore`` to hits; made by a trainer from positives, negatives and the round.
Scorer = Callable[[DataFrame], DataFrame]
Trainer = Callable[[DataFrame, DataFrame, int], Scorer]


def boosted_trainer(names: list[str], p: ScorerParams) -> Trainer:
    """Boosted trees on standardised features; a tenth of the rows, by hash, is left out of training."""

    def train(positives: DataFrame, negatives: DataFrame, turn: int) -> Scorer:
        both = positives.withColumn("label", F.lit(1.0)).unionByName(negatives.withColumn("label", F.lit(0.0)))
        own = both.where(F.pmod(F.xxhash64("PSMId"), F.lit(10)) != 0)
        vectors = VectorAssembler(inputCols=names, outputCol="__raw", handleInvalid="keep")
        scaled = StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True).fit(vectors.transform(own))
        model = GBTClassifier(maxIter=p.trees, maxDepth=p.depth, seed=p.seed).fit(scaled.transform(vectors.transform(own)))

        def score(rows: DataFrame) -> DataFrame:
            out = model.transform(scaled.transform(vectors.transform(rows)))
            return out.select(*rows.columns, vector_to_array("rawPrediction")[1].alias("ModelScore"))

        return score

    return train


def best_per_scan(rows: DataFrame, score: str) -> DataFrame:
    """Of each scan the hit with the highest score (ties: the lesser PSMId); counted before the shuffle, so a scan of many hits is no task."""
    best = F.min_by(F.struct(*rows.columns), F.struct((-F.col(score).cast("double")).alias("s"), F.col("PSMId").alias("i")))
    return rows.groupBy(F.col("ScanNr").alias("__scan")).agg(best.alias("__b")).select("__b.*")


def _negatives(hits: DataFrame, positives: DataFrame) -> DataFrame:
    """Decoy hits of the scans that have no positive."""
    return hits.where("Label = -1").join(positives.select("ScanNr"), "ScanNr", "left_anti")


@dataclass(frozen=True)
class Applied:
    """A model's best hit of each scan, with ModelScore, QValue and PEPValue, and the hits under the thresholds."""

    best: DataFrame
    hits: int


def applied(hits: DataFrame, score: Scorer, p: ScorerParams) -> Applied:
    best = cut(best_per_scan(score(hits), "ModelScore"))
    decoy = F.col("Label") == -1
    best = q_between(storey_q(best, "ModelScore", decoy), best, "ModelScore").withColumnRenamed("q_value", "QValue")
    best = cut(irls_pep(best, "ModelScore", decoy, "PEPValue"))
    n = best.agg(F.count_if(F.col("QValue") <= p.q).alias("q"), F.count_if(F.col("PEPValue") <= p.pep).alias("pep")).first()
    return Applied(best, min(n["q"], n["pep"]))


def refined(hits: DataFrame, train: Trainer, p: ScorerParams, first: str) -> tuple[Applied | None, list[Round]]:
    """The model that the rounds end with, as applied to ``hits``, and each round. None where not even the first model can be learned.

    Each round learns from the previous model's confident targets, the best hit of a scan each, and from the decoys of all scans
    without one. It ends at ``max_rounds``; when the hits under the thresholds fall, with the previous model; and when they grow by
    less than ``min_gain``, with the new one. A model that cannot be trained leaves the previous one.
    """
    best = best_per_scan(hits, first)
    ranked = q_between(storey_q(best, first, F.col("Label") == -1), best, first)
    positives = cut(ranked.where((F.col("q_value") < p.first_q) & (F.col("Label") == 1)).drop("q_value"))
    kept, rounds = None, []
    for turn in range(p.max_rounds + 1):
        if kept is not None:
            sure = (F.col("QValue") < p.q / 10) & (F.col("PEPValue") < p.pep) & (F.col("Label") == 1)
            positives = cut(kept.best.where(sure).select(*hits.columns))
        negatives = cut(_negatives(hits, positives))
        n_pos, n_neg = positives.count(), negatives.count()
        if not n_pos or not n_neg:
            rounds.append(Round(n_pos, n_neg, 0, "nothing to learn from"))
            return kept, rounds
        new = applied(hits, train(positives, negatives, turn), p)
        if kept is None:
            outcome = "first"
        elif kept.hits > new.hits:
            outcome = "fewer hits: previous model"
        elif new.hits and 1 - kept.hits / new.hits < p.min_gain:
            outcome = "small gain: new model"
        else:
            outcome = "next"
        rounds.append(Round(n_pos, n_neg, new.hits, outcome))
        if outcome.startswith("fewer"):
            return kept, rounds
        kept = new
        if outcome.startswith("small"):
            return kept, rounds
    return kept, rounds


def scored_psms(psms: DataFrame, p: ScorerParams = ScorerParams(), first: str = "SequestScore", train: Trainer | None = None) -> tuple[DataFrame, list[Round]]:
    """The confident target hits of ``psms`` with ModelScore, QValue and PEPValue, and the rounds that led to the model.

    ``psms`` has PSMId (its own for each hit), ScanNr, Label (1 target, -1 decoy), Charge and the scores. Hits without a distance to
    the next candidate (NaN or missing) take no part. A result is the best hit of its scan, a target, and under both thresholds.
    Where nothing can be learned the table is empty, with the same columns. What reaches the driver is three counts a round.
    """
    schema = psms.withColumns({c: F.lit(0.0) for c in ("ModelScore", "QValue", "PEPValue")}).schema
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    x, names = features(psms.where(known("SequestNormDeltaNext") & known("AndroNormDeltaNext")), p)
    hits = cut(x.fillna(0.0, subset=[n for n in names if n in SCORES]))
    model, rounds = refined(hits, train or boosted_trainer(names, p), p, first)
    if model is None:
        return empty_table(psms.sparkSession, schema), rounds
    out = model.best.where((F.col("QValue") < p.q) & (F.col("PEPValue") < p.pep) & (F.col("Label") == 1))
    return out.select(*psms.columns, "ModelScore", "QValue", "PEPValue"), rounds
