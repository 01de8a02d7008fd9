"""The scorer's rounds step by step, each way they end, and posterior errors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.operators import fdr
from ionloom.plans import psm_statistics as P
from ionloom.plans.psm_statistics import ScorerParams


def hits(spark, scans=60, seed=1):
    """Two hits a scan; ``s0`` .. ``s3`` are the scores that the trainers of the tests hand out, better and better or worse."""
    r, rows = random.Random(seed), []
    for i in range(scans):
        for k in range(2):
            target = r.random() < (0.85 if k == 0 else 0.4)
            base = (3.0 if target else 0.0) + r.gauss(0, 1) - k
            rows.append((f"{i:03d}-{k}", i, 1 if target else -1, base, base + (2.0 if target else -2.0), base + (2.1 if target else -2.1), r.gauss(0, 1)))
    return spark.createDataFrame(rows, "PSMId string, ScanNr int, Label int, s0 double, s1 double, s2 double, s3 double")


def trainer(log, names):
    """Hands out one column a round as the model's score."""

    def train(positives, negatives, turn):
        log.append((turn, {r.PSMId for r in positives.collect()}, {r.PSMId for r in negatives.collect()}))
        if names[turn] is None:
            raise RuntimeError("training failed")
        return lambda rows: rows.withColumn("ModelScore", F.col(names[turn]))

    return train


def storey(best, score):
    """{PSMId: q} of the best hits, from the definition."""
    out, d, t = [], 0, 0
    for x in sorted({score(h) for h in best}, reverse=True):
        d, t = d + sum(score(h) == x and h.Label < 0 for h in best), t + sum(score(h) == x and h.Label > 0 for h in best)
        out.append((x, d / max(t, 1)))
    low = {}
    for x, q in reversed(out):
        low[x] = min([q, *low.values()])
    return {h.PSMId: low[score(h)] for h in best}


def best_of(rows, score):
    by = {}
    for h in rows:
        by.setdefault(h.ScanNr, []).append(h)
    return [min(v, key=lambda h: (-score(h), h.PSMId)) for v in by.values()]


LOOSE = ScorerParams(first_q=0.05, q=0.5, pep=0.9, max_rounds=3, min_gain=0.2)


def test_the_first_round_learns_from_best_hits_and_scans_without_one(spark):
    df, log = hits(spark), []
    rows = df.collect()
    _, rounds = P.refined(P.cut(df), trainer(log, ["s1", "s2", "s2"]), LOOSE, "s0")
    best = best_of(rows, lambda h: h.s0)
    q = storey(best, lambda h: h.s0)
    positives = {h.PSMId for h in best if h.Label == 1 and q[h.PSMId] < LOOSE.first_q}
    taken = {h.ScanNr for h in rows if h.PSMId in positives}
    assert positives and log[0][1] == positives
    assert log[0][2] == {h.PSMId for h in rows if h.Label == -1 and h.ScanNr not in taken}
    assert rounds[0].outcome == "first" and (rounds[0].positives, rounds[0].negatives) == (len(log[0][1]), len(log[0][2]))


def test_later_rounds_learn_from_a_tenth_of_the_threshold(spark):
    df, log = hits(spark), []
    p = ScorerParams(first_q=0.05, q=0.4, pep=0.3, max_rounds=2, min_gain=-1.0)
    kept, _ = P.refined(P.cut(df), trainer(log, ["s0", "s0", "s0"]), p, "s0")
    best = {r.PSMId: r for r in kept.best.collect()}
    q = storey(best_of(df.collect(), lambda h: h.s0), lambda h: h.s0)
    assert {k: r.QValue for k, r in best.items()} == pytest.approx(q)
    assert log[1][1] == {k for k, r in best.items() if r.QValue < 0.04 and r.PEPValue < 0.3 and r.Label == 1}
    assert kept.hits == min(sum(r.QValue <= 0.4 for r in best.values()), sum(r.PEPValue <= 0.3 for r in best.values()))


def test_it_ends_at_the_last_round(spark):
    log = []
    p = ScorerParams(first_q=0.05, q=0.5, pep=0.9, max_rounds=2, min_gain=-1.0)
    _, rounds = P.refined(P.cut(hits(spark)), trainer(log, ["s0"] * 9), p, "s0")
    assert [x[0] for x in log] == [0, 1, 2] and [r.outcome for r in rounds] == ["first", "next", "next"]


def test_it_ends_with_the_previous_model_when_hits_fall(spark):
    log = []
    p = ScorerParams(first_q=0.05, q=0.3, pep=0.5, max_rounds=9, min_gain=0.005)
    kept, rounds = P.refined(P.cut(hits(spark)), trainer(log, ["s1", "s3"]), p, "s0")
    assert [r.outcome for r in rounds] == ["first", "fewer hits: previous model"] and rounds[1].hits < rounds[0].hits == kept.hits
    assert all(r.ModelScore == r.s1 for r in kept.best.collect())


def test_it_ends_with_the_new_model_when_the_gain_is_small(spark):
    log = []
    kept, rounds = P.refined(P.cut(hits(spark)), trainer(log, ["s1", "s2"]), LOOSE, "s0")
    assert [r.outcome for r in rounds] == ["first", "small gain: new model"]
    assert all(r.ModelScore == r.s2 for r in kept.best.collect())


def test_it_keeps_the_previous_model_when_there_is_nothing_to_learn_from(spark):
    p = ScorerParams(first_q=0.05, q=1e-9, pep=0.9, max_rounds=9)  # no hit is under a tenth of q, as the first has decoys above it
    df = hits(spark).unionByName(spark.createDataFrame([("zzz", 999, -1, 9.0, 99.0, 99.0, 9.0)], "PSMId string, ScanNr int, Label int, s0 double, s1 double, s2 double, s3 double").withColumn("s0", F.lit(-9.0)))
    kept, rounds = P.refined(P.cut(df), trainer([], ["s1", "s2"]), p, "s0")
    assert [r.outcome for r in rounds] == ["first", "nothing to learn from"] and all(r.ModelScore == r.s1 for r in kept.best.collect())
    none, first = P.refined(P.cut(df.where("Label = 1")), trainer([], ["s1"]), p, "s0")
    assert none is None and [r.outcome for r in first] == ["nothing to learn from"]


def _psms(spark):
    r, rows = random.Random(5), []
    for i in range(400):
        target = r.random() < 0.6
        good = target and r.random() < 0.8
        rows.append((f"p{i}", i // 2, 1 if target else -1, 2 + i % 3, *[r.gauss(4 if good else 0, 1) for _ in range(3 + len(P.SCORES))], 8, 0))
    names = ["PrecursorMZ", "TheoMass", "AbsDeltaMass", *P.SCORES]
    return spark.createDataFrame(rows, "PSMId string, ScanNr int, Label int, Charge int, " + ", ".join(f"{n} double" for n in names) + ", PeptideLength int, MissCleavages int").withColumn("extra", F.lit("e"))


def test_a_run_with_trees(spark):
    psms = _psms(spark)
    gap = psms.withColumn("AndroNormDeltaNext", F.when(F.col("PSMId") == "p0", float("nan")).when(F.col("PSMId") != "p1", F.col("AndroNormDeltaNext")))
    out, rounds = P.scored_psms(gap, ScorerParams(trees=3, max_rounds=2, first_q=0.01, q=0.05))
    rows = out.collect()
    assert rounds[0].outcome == "first" and len(rows) > 60 and out.columns == [*gap.columns, "ModelScore", "QValue", "PEPValue"]
    assert all(x.Label == 1 and x.QValue < 0.05 and x.PEPValue < 0.05 for x in rows)
    assert len({x.ScanNr for x in rows}) == len(rows) and not {"p0", "p1"} & {x.PSMId for x in rows}
    none, _ = P.scored_psms(gap.where("Label = 1"))
    assert none.count() == 0 and none.columns == out.columns
    assert P.scored_psms(gap.limit(0))[0].count() == 0


def test_posterior_errors_follow_the_odds_of_decoys(spark):
    rng = np.random.default_rng(3)
    scores = np.concatenate([rng.normal(0, 1, 4000), rng.normal(0, 1, 4000), rng.normal(4, 1, 4000)])
    df = spark.createDataFrame([(float(x), i < 4000) for i, x in enumerate(scores)], "s double, decoy boolean")
    got = fdr.irls_pep(df, "s", F.col("decoy"), "pep").where("abs(s) < 5").collect()
    for at in (0.0, 1.0, 2.0, 3.0, 4.0):
        # As many false targets as decoys of one score, so the odds of a decoy are the share of false targets.
        false, true = math.exp(-(at**2) / 2), math.exp(-((at - 4) ** 2) / 2)
        near = [x.pep for x in got if abs(x.s - at) < 0.02]
        assert np.mean(near) == pytest.approx(false / (false + true), abs=0.06), at
    assert all(0 <= x.pep <= 1 for x in got)


def test_posterior_errors_without_a_fit(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (None, True), (float("nan"), True)], "s double, decoy boolean")
    assert [x.pep for x in fdr.irls_pep(df, "s", F.col("decoy"), "pep").collect()] == [1.0, 1.0, None, None]
    assert [x.pep for x in fdr.irls_pep(df, "s", ~F.col("decoy"), "pep").collect()] == [0.0, 0.0, None, None]
    assert fdr.irls_pep(df.limit(0), "s", F.col("decoy"), "pep").count() == 0
    flat = spark.createDataFrame([(1.0, True), (1.0, False), (1.0, False)], "s double, decoy boolean")
    assert all(x.pep == pytest.approx(0.5, abs=0.01) for x in fdr.irls_pep(flat, "s", F.col("decoy"), "pep").collect())
