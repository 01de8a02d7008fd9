"""Mixing sources to target weights: token weights raked to marginals, documents sampled by calibrated probability.

Tokens are summed by cell (source, language, topic). Iterative proportional fitting scales the cells' weights to
the target share of each source, language and topic in turn, until the rounds are over. A document's weight is
its cell's. Its probability starts from that weight and is raked again with 1 as its bound: cells at the bound stay
there while the others of their class give what is missing, until the expected tokens of the sample are ``rate`` of
all tokens and have the target shares. A class that has fewer tokens than its target is taken whole, and the others share
what it lacks. The document's hash against the probability decides.

Cells are as many as sources times a few. Up to ``LOCAL_CELLS`` of them, counted first, are fitted in numpy on the driver; a larger
table is fitted by sums and joins, with the same steps and the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, words_of

DIMS = ("source", "lang", "topic")
LOCAL_CELLS = 200_000


@dataclass(frozen=True)
class MixParams:
    #: Target share of a marginal class: its share of tokens to this power, normalised (1 keeps, 0 equalises).
    source_power: float = 0.5
    lang_power: float = 0.8
    topic_power: float = 0.8
    rounds: int = 6
    #: The bounded raking ends when no class is further than ``near`` from its target, relative to it, or after so many rounds.
    bounded_rounds: int = 60
    near: float = 1e-3
    rate: float = 0.7
    seed: int = 20
    #: A column that names the topic; without one ``topic_of`` reads it from the text.
    topic_column: str | None = None

    def power(self, dim: str) -> float:
        return {"source": self.source_power, "lang": self.lang_power, "topic": self.topic_power}[dim]


def topic_of(text: Column) -> Column:
    """A surface topic: what the first fitting rule says. Null texts are prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(r"(?i)licen[cs]ed? |all rights reserved"), "legal").when(F.contains(t, F.lit(" | ")), "table").when(F.contains(t, F.lit("@")), "contact").when(F.length(t) > 4000, "long").otherwise("prose")


def with_sums(cells: DataFrame, d: str, **sums: Column) -> DataFrame:
    """``cells`` with sums over their class of ``d``, by partial sums and a join: no task sees all cells of a class."""
    own = cells.groupBy(F.col(d).alias("k")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return cells.join(own, F.col(d).eqNullSafe(F.col("k"))).drop("k")


def cell_weights(cells: DataFrame, p: MixParams) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with the weight of each after fitting, token mean 1.

    One row per cell; each round joins that table with the sums of its classes three times, and its lineage is cut once a
    round. Cells without tokens have weight 1. Targets that the cells cannot meet together are met as nearly as the rounds allow.
    """
    df = cells.withColumn("weight", F.lit(1.0))
    for d in DIMS:
        own = df.groupBy(d).agg(F.sum("tokens").alias("t")).withColumn("raw", F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(p.power(d)))).otherwise(F.lit(0.0)))
        df = df.join(own.select(F.col(d).alias("k"), F.col("raw").alias(f"raw_{d}")), F.col(d).eqNullSafe(F.col("k"))).drop("k")
        norm = own.agg(F.sum("raw").alias("n")).first()["n"] or 1.0
        df = df.withColumn(f"target_{d}", F.col(f"raw_{d}") / norm).drop(f"raw_{d}")
    tokens = (cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0) * 1.0
    for _ in range(p.rounds):
        for d in DIMS:
            df = with_sums(df, d, have=F.col("weight") * F.col("tokens"))
            df = df.withColumn("weight", F.when(F.col("have") > 0, F.col("weight") * F.col(f"target_{d}") * tokens / F.col("have")).otherwise(F.col("weight"))).drop("have")
        df = cut(df)
    return df.select(*DIMS, "tokens", "weight")


def class_tokens(cells: DataFrame, d: str, p: MixParams, total: int) -> DataFrame:
    """k, want: the tokens that the sample shall hold of each class of ``d``, ``rate`` of ``total`` together.

    They are in proportion to the target shares; classes with fewer tokens give all, the others the rest in proportion.
    """
    own = cut(cells.groupBy(d).agg(F.sum("tokens").alias("t")).select(F.col(d).alias("k"), "t", F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(p.power(d)))).otherwise(F.lit(0.0)).alias("raw")))
    factor, short = p.rate * total / own.agg(F.sum("raw").alias("n")).first()["n"], 0
    while True:  # the factor only grows, so each round adds classes that give all
        whole = F.col("t") <= F.col("raw") * factor
        got = own.agg(F.count_if(whole).alias("n"), F.sum(F.when(whole, F.col("t")).otherwise(0)).alias("t"), F.sum(F.when(whole, 0.0).otherwise(F.col("raw"))).alias("raw")).first()
        if got["n"] == short or not got["raw"]:
            return own.select("k", F.least(F.col("t").cast("double"), F.col("raw") * factor).alias("want"))
        factor, short = (p.rate * total - got["t"]) / got["raw"], got["n"]


def cell_probabilities(cells: DataFrame, p: MixParams) -> DataFrame:
    """``cells`` (source, lang, topic, tokens, weight) with the probability of each: at most 1, and such that the expected tokens of
    every class are those of ``class_tokens``, or as near as the cells allow together.

    Each step scales a class so that its cells below 1 and those at 1 make up what the class shall hold. Rounds end when every
    class is ``near``, or when six more bring nothing nearer: then the cells cannot meet all targets together.
    """
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    if not total:
        return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight")))
    df = cells.withColumn("free", F.col("weight") * p.rate)
    for d in DIMS:
        df = df.join(class_tokens(cells, d, p, total).withColumnRenamed("want", f"want_{d}"), F.col(d).eqNullSafe(F.col("k"))).drop("k")
    df, held, before = cut(df), F.least(F.lit(1.0), F.col("free")), float("inf")
    for n in range(1, p.bounded_rounds + 1):
        for d in DIMS:
            df = with_sums(df, d, full=F.when(F.col("free") >= 1, F.col("tokens")).otherwise(0), rest=F.when(F.col("free") < 1, F.col("tokens") * F.col("free")).otherwise(0.0))
            full, rest, want = F.col("full"), F.col("rest"), F.col(f"want_{d}")
            by = F.when((want > full) & (rest > 0), (want - full) / rest).when(full + rest > 0, want / (full + rest)).otherwise(F.lit(1.0))
            # A step is at most fourfold: cells that pass 1 on the way are seen to in the next round.
            df = df.withColumn("by", F.greatest(F.lit(0.25), F.least(F.lit(4.0), by))).withColumn("free", F.col("free") * F.col("by")).drop("by", "full", "rest")
        if n % 2 == 0:
            df = cut(df)
        if n % 6 == 0:
            off = max(farthest(df, d, held) for d in DIMS)
            if off < p.near or off > 0.99 * before:
                break
            before = off
    return df.select(*DIMS, "tokens", "weight", held.alias("probability"))


def farthest(cells: DataFrame, d: str, held: Column) -> float:
    """How far the farthest class of ``d`` is from what it shall hold, relative to it."""
    own = cells.groupBy(d, f"want_{d}").agg(F.sum(F.col("tokens") * held).alias("got")).where(F.col(f"want_{d}") > 0)
    return own.agg(F.max(F.abs(F.col("got") / F.col(f"want_{d}") - 1))).first()[0] or 0.0


def fit_local(cells: pd.DataFrame, p: MixParams) -> pd.DataFrame:
    """``cells`` (source, lang, topic, tokens) with weight and probability: the steps of ``cell_weights`` and ``cell_probabilities``."""
    tokens, n = cells["tokens"].to_numpy(np.float64), len(cells)
    total, weight = tokens.sum(), np.ones(n)
    if not total:
        return cells.assign(weight=weight, probability=np.minimum(1.0, weight))
    codes = {d: pd.factorize(cells[d], use_na_sentinel=False)[0] for d in DIMS}
    sums = {d: lambda x, c=codes[d]: np.bincount(c, x) for d in DIMS}
    own = {d: sums[d](tokens) for d in DIMS}
    raw = {d: np.where(own[d] > 0, own[d] ** p.power(d), 0.0) for d in DIMS}
    for _ in range(p.rounds):
        for d in DIMS:
            have = sums[d](weight * tokens)
            weight = weight * np.divide(raw[d] / raw[d].sum() * total, have, out=np.ones_like(have), where=have > 0)[codes[d]]
    want = {}
    for d in DIMS:
        factor, short = p.rate * total / raw[d].sum(), 0
        while True:
            whole = own[d] <= raw[d] * factor
            rest = raw[d][~whole].sum()
            if whole.sum() == short or not rest:
                break
            factor, short = (p.rate * total - own[d][whole].sum()) / rest, whole.sum()
        want[d] = np.minimum(own[d], raw[d] * factor)
    free, before = weight * p.rate, np.inf
    for k in range(1, p.bounded_rounds + 1):
        for d in DIMS:
            full, rest = sums[d](np.where(free >= 1, tokens, 0.0)), sums[d](np.where(free < 1, tokens * free, 0.0))
            by = np.ones_like(full)
            fill, shrink = (want[d] > full) & (rest > 0), full + rest > 0
            by[shrink] = want[d][shrink] / (full + rest)[shrink]
            by[fill] = (want[d] - full)[fill] / rest[fill]
            free = free * np.clip(by, 0.25, 4.0)[codes[d]]
        if k % 6 == 0:
            got = {d: sums[d](tokens * np.minimum(1.0, free)) for d in DIMS}
            off = max(float(np.abs(got[d][want[d] > 0] / want[d][want[d] > 0] - 1).max(initial=0.0)) for d in DIMS)
            if off < p.near or off > 0.99 * before:
                break
            before = off
    return cells.assign(weight=weight, probability=np.minimum(1.0, free))


def fit_cells(cells: DataFrame, p: MixParams, most: int = LOCAL_CELLS) -> tuple[DataFrame, bool]:
    """``cells`` with weight and probability, and whether they are few enough to be broadcast."""
    if cells.limit(most + 1).count() > most:
        return cut(cell_probabilities(cut(cell_weights(cells, p)), p)), False
    rows = cells.select(*DIMS, "tokens").collect()
    fitted = fit_local(pd.DataFrame([tuple(r) for r in rows], columns=[*DIMS, "tokens"]).astype({d: object for d in DIMS}), p)
    values = [(*tuple(r), float(w), float(q)) for r, w, q in zip(rows, fitted["weight"], fitted["probability"], strict=True)]
    schema = ", ".join(f"{d} {cells.schema[d].dataType.simpleString()}" for d in DIMS) + ", tokens bigint, weight double, probability double"
    return cells.sparkSession.createDataFrame(values, schema), True


def mix(docs: DataFrame, p: MixParams = MixParams()) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with topic, tokens, weight, probability and sampled, under the names that the dict gives.

    Null sources and languages are classes like any other. Null and blank texts have no tokens; their weight is
    their cell's. The sample is a hash of doc_id, so repeated rows share its decision and a rerun repeats it; rows
    with a null id share one. Empty input: no rows.
    """
    names = dict(zip(("topic", "tokens", "weight", "probability", "sampled"), fresh(docs, "m_topic", "m_tokens", "m_weight", "m_probability", "m_sampled"), strict=True))
    topic, tokens, weight, prob, sampled = names.values()
    rows = docs.withColumn(topic, topic_of(F.col("text")) if p.topic_column is None else F.col(p.topic_column).cast("string")).withColumn(tokens, F.size(words_of(F.col("text"))).cast("bigint"))
    cells = cut(rows.groupBy("source", "lang", F.col(topic).alias("topic")).agg(F.sum(tokens).alias("tokens")))
    fitted, few = fit_cells(cells, p)
    keys = fresh(rows, *[f"c_{d}" for d in DIMS])
    side = fitted.select(*[F.col(d).alias(k) for d, k in zip(DIMS, keys, strict=True)], F.col("weight").alias(weight), F.col("probability").alias(prob))
    on = rows["source"].eqNullSafe(side[keys[0]]) & rows["lang"].eqNullSafe(side[keys[1]]) & rows[topic].eqNullSafe(side[keys[2]])
    side = F.broadcast(side) if few else side
    out = rows.join(side, on, "left").drop(*keys)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(p.seed)), F.lit(1 << 53)) / float(1 << 53)
    return out.withColumn(sampled, u < F.col(prob)), names


def mixed(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The sampled documents, with the columns of ``docs``."""
    out, names = mix(docs, p)
    return out.where(F.col(names["sampled"])).select(*docs.columns)
