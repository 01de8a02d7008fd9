"""Set containment, groups of both strictnesses and all usages, and the inference run against plain loops."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions.columns import bare_sequence
from ionloom.operators import fdr
from ionloom.operators.containment import containment_join
from ionloom.operators.inference import grouped, peptide_classes
from ionloom.plans.protein_inference import InferenceParams, infer_proteins, reversed_peptides


@pytest.mark.parametrize("seed", range(3))
def test_containment_is_that_of_plain_loops(spark, seed):
    r = random.Random(seed)
    items = lambda: [r.choice(["hot", *"abcdefgh", None]) for _ in range(r.randint(0, 6))] + ["hot"] * r.randint(0, 1)
    left, right = [(r.choice("xy"), f"l{i}", items()) for i in range(80)], [(r.choice("xy"), f"r{i}", items()) for i in range(80)] + [("x", "r80", None)]
    a, b = spark.createDataFrame(left, "k string, l string, v array<string>"), spark.createDataFrame(right, "k string, r string, w array<string>")
    bare = lambda v: {x for x in v or [] if x is not None}
    want = sorted((k, i, j) for k, i, v in left for m, j, w in right if k == m and bare(v) and bare(v) <= bare(w))
    assert sorted(map(tuple, containment_join(a, b, "l", "r", "v", "w", ["k"]).collect())) == want
    every = sorted((i, j) for _, i, v in left for _, j, w in right if bare(v) and bare(v) <= bare(w))
    assert sorted(map(tuple, containment_join(a, b, "l", "r", "v", "w").collect())) == every
    assert containment_join(a.limit(0), b, "l", "r", "v", "w").count() == 0


def test_pairs_that_meet_share_the_rarest_item(spark):
    """A thousand sets that share a frequent item: each is looked up by its own, so the join emits a pair a set and no more."""
    rows = spark.range(1000).select(F.concat(F.lit("s"), F.col("id")).alias("l"), F.array(F.lit("hot"), F.col("id").cast("string")).alias("v"))
    out = containment_join(rows, rows.select(F.col("l").alias("r"), F.col("v").alias("w")), "l", "r", "v", "w")
    assert out.count() == 1000 and out.where("l <> r").count() == 0


def _points(seed):
    r = random.Random(seed)
    return {f"PEP{i}": sorted({r.choice("ABCDEF") for _ in range(r.randint(1, 4))}) for i in range(40)}


@pytest.mark.parametrize("seed", range(3))
def test_groups_by_the_peptides_they_explain(spark, seed):
    """Strictness from its definition on peptides: a group goes if another one's peptides hold all that point to it."""
    points = _points(seed)
    found = spark.createDataFrame([(p, ";".join(s), "C1a") for p, s in points.items()], "sequence string, protein_group string, class string")
    groups = {tuple(s) for s in points.values()}
    explained = {g: {p for p, s in points.items() if set(g) <= set(s)} for g in groups}
    strict = {g for g in groups if not any(h != g and explained[g] <= explained[h] for h in groups)}
    assert strict < groups
    uses = {
        "minimal": lambda g: {p for p, s in points.items() if tuple(s) == g},
        "maximal": lambda g: {p for p, s in points.items() if set(s) & set(g)},
        "inverse": lambda g: explained[g],
    }
    for strictness, kept in (("maximal", groups), ("minimal", strict)):
        for usage, peptides in uses.items():
            got = {r.protein_group: r.peptides for r in grouped(found, [], usage, strictness).collect()}
            assert got == {";".join(g): ";".join(sorted(peptides(g))) for g in kept}
    with pytest.raises(ValueError):
        grouped(found, [], "other")


def test_groups_of_files_apart(spark):
    rows = [("f", "P1", "A;B"), ("f", "P2", "A"), ("g", "P1", "A;B")]
    found = spark.createDataFrame([(f, p, g, "C1a") for f, p, g in rows], "file string, sequence string, protein_group string, class string")
    got = {(r.file, r.protein_group, r.peptides) for r in grouped(found, ["file"], "inverse", "minimal").collect()}
    assert got == {("f", "A", "P1;P2"), ("g", "A;B", "P1")}


def test_decoy_proteins_without_a_group(spark):
    scored = spark.createDataFrame([("A;B", "C1a", "P", 5.0, 2.0, False)], "protein_group string, class string, peptides string, target_score double, decoy_score double, decoy_bigger boolean")
    decoys = spark.createDataFrame([("B", 2.0), ("Z", 7.0)], "protein string, decoy_score double")
    got = sorted(map(tuple, fdr.with_decoy_only(scored, decoys).collect()))
    assert got == [("A;B", "C1a", "P", 5.0, 2.0, False, False), ("Z", "Unknown", "", 0.0, 7.0, True, True)]
    assert fdr.with_decoy_only(scored, decoys.limit(0)).count() == 1 and fdr.with_decoy_only(scored.limit(0), decoys).count() == 2


def _run(psms, points, back, by_file):
    """The run from its rules: {(file, group): (peptides, target, decoy, q)}."""
    out = {}
    for files in ([{f} for f in sorted({f for f, _, _ in psms})] if by_file else [{f for f, _, _ in psms}]):
        best, bare = {}, {}
        for f, s, x in psms:
            if f in files:
                best[s] = max(best.get(s, -np.inf), x)
        strip = lambda s: "".join(c for c in s if c.isupper())
        for s in sorted(best):
            bare[strip(s)] = best[s]
        group = lambda s: points.get(strip(s)) or points["M" + strip(s)]
        groups = collections.defaultdict(set)
        for s in best:
            groups[";".join(group(s))].add(s)
        decoy = collections.Counter()
        for protein, p in back:
            decoy[protein] += bare.get(p, 0.0)
        decoy = {k: v for k, v in decoy.items() if v}
        items = [(g, sum(best[s] for s in own), max(decoy.get(m, 0.0) for m in g.split(";"))) for g, own in groups.items()]
        items = [(g, t, d, d > t, False) for g, t, d in items]
        there = {m for g in groups for m in g.split(";")}
        items += [(m, 0.0, d, True, True) for m, d in decoy.items() if m not in there]
        knots, nd, nt = [], 0, 0
        marks = collections.defaultdict(lambda: [0, 0])
        for _, t, d, big, _ in items:
            marks[d if big else t][big] += 1
        for x in sorted(marks, reverse=True):
            nt, nd = nt + marks[x][0], nd + marks[x][1]
            knots.append([x, nd / max(nt, 1)])
        knots = knots[::-1]
        for a, b in zip(knots, knots[1:]):
            b[1] = min(a[1], b[1])
        xs, ys = np.array(knots).T

        def q(v):
            i = int(np.clip(np.searchsorted(xs, v, "right") - 1, 0, len(xs) - 2))  # noqa: B023
            return ys[i] + (v - xs[i]) * (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i])  # noqa: B023

        for g, t, d, _, alone in items:
            if not alone:
                for f in files:
                    own = sorted(s for s in groups[g] if any(s == y and f == z for z, y, _ in psms))
                    if own:
                        out[f, g] = (";".join(own), t, d, q(t))
    return out


@pytest.mark.parametrize("by_file", [False, True])
def test_the_run_from_peptides_to_q_values(spark, by_file):
    r = random.Random(8)
    letters = "ACDEFGHIKLNPQRSTVWY"
    points = {"".join(r.choice(letters) for _ in range(6)): sorted({f"p{r.randrange(12)}" for _ in range(r.randint(1, 3))}) for _ in range(60)}
    points["MSTART"] = ["p1"]
    seqs = [*points, "START", "A[ox]" + next(iter(points))[1:] if next(iter(points))[0] == "A" else next(iter(points))]
    psms = [(r.choice("fgh"), s, round(r.uniform(1, 40), 1)) for s in seqs if s != "MSTART" for _ in range(r.randint(1, 3))]
    back = [(f"p{r.randrange(25)}", r.choice(list(points))) for _ in range(40)]
    pairs = spark.createDataFrame([(p, m) for p, s in points.items() for m in s], "peptide string, protein string")
    proteins = pairs.select("protein").distinct().withColumns({"locus": F.col("protein"), "sequence": F.lit(None).cast("string")})
    df = spark.createDataFrame(psms + psms[:5], "file string, sequence string, score double").withColumn("extra", F.lit(1))
    got = infer_proteins(df, peptide_classes(pairs, proteins), spark.createDataFrame(back, "protein string, peptide string"), InferenceParams(group_files=not by_file))
    rows = {(x.file, x.ProteinGroup): x for x in got.collect()}
    want = _run(psms, points, back, by_file)
    assert rows.keys() == want.keys() and len(rows) > 20
    for k, (peptides, t, d, q) in want.items():
        x = rows[k]
        assert (x.PeptideSequence, x.TargetScore, x.DecoyScore) == (peptides, pytest.approx(t), pytest.approx(d)) and x.QValue == pytest.approx(q), k
    assert any(x.QValue > 0 for x in rows.values())


def test_other_runs(spark):
    pairs = spark.createDataFrame([("AK", "p")], "peptide string, protein string")
    proteins = spark.createDataFrame([("p", "p", "AKCCRAK")], "protein string, locus string, sequence string")
    classes, back = peptide_classes(pairs, proteins), reversed_peptides(proteins, InferenceParams(max_missed=0))
    assert sorted(x.peptide for x in back.collect()) == ["A", "AR", "CCK", "K"]
    psms = spark.createDataFrame([("f", "AK", 2.0)], "file string, sequence string, score double")
    none = infer_proteins(psms, classes, back, InferenceParams(q_value=None)).collect()
    assert [(x.ProteinGroup, x.TargetScore, x.QValue) for x in none] == [("p", 2.0, None)]
    assert infer_proteins(psms.limit(0), classes, back).count() == 0
    with pytest.raises(Exception, match="no protein for"):
        infer_proteins(spark.createDataFrame([("f", "XX", 2.0)], "file string, sequence string, score double"), classes, back).collect()
    assert spark.createDataFrame([("A[ox]K",)], "s string").select(bare_sequence(F.col("s"))).first()[0] == "AK"
