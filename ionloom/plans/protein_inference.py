"""Protein inference as one plan: peptides of files to protein groups with evidence classes, scores and q-values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bare_sequence, digest
from ..operators.fdr import digested_scores, group_q_values, peptide_scores, with_decoy_only, with_decoy_scores
from ..operators.inference import grouped, peptide_classes
from ..operators.lineage import cut


@dataclass(frozen=True)
class InferenceParams:
    #: Which groups are reported, and which peptides they have; see ``operators.inference.grouped``.
    strictness: str = "maximal"
    usage: str = "minimal"
    #: Groups, scores and q-values over all files at once, or of each file by itself.
    group_files: bool = True
    #: ``storey``, or None for missing q-values.
    q_value: str | None = "storey"
    protease: str = "trypsin"
    max_missed: int = 2


def reversed_peptides(proteins: DataFrame, p: InferenceParams = InferenceParams()) -> DataFrame:
    """protein, peptide: the peptides of each protein's reversed sequence, a row for each time one is cut. ``proteins``: protein, sequence."""
    cuts = proteins.select("protein", F.explode(digest(F.reverse("sequence"), p.protease, p.max_missed)).alias("d"))
    return cuts.select("protein", F.col("d.peptide").alias("peptide"))


def classified(psms: DataFrame, classes: DataFrame) -> DataFrame:
    """``psms`` with the protein group and class of their bare sequence, or of that after an M; a sequence with neither is an error."""
    side = lambda c, key, n: c.select(key.alias(f"__p{n}"), F.struct("protein_group", "class").alias(f"__c{n}"))
    # Peptides with an M go by what follows it, so both joins meet at the bare sequence and only these peptides are read again.
    after = classes.where(F.startswith("peptide", F.lit("M")))
    met = psms.withColumn("__bare", bare_sequence(F.col("sequence"))).join(side(classes, F.col("peptide"), 1), F.col("__bare") == F.col("__p1"), "left")
    met = met.join(side(after, F.expr("substring(peptide, 2)"), 2), (F.col("__bare") == F.col("__p2")) & F.col("__c1").isNull(), "left")
    missing = F.raise_error(F.concat(F.lit("no protein for "), F.coalesce("sequence", F.lit("null")))).cast("struct<protein_group string, class string>")
    c = F.coalesce("__c1", "__c2", missing)
    return met.select(*psms.columns, c["protein_group"].alias("protein_group"), c["class"].alias("class"))


def infer_proteins(psms: DataFrame, classes: DataFrame, decoy_peptides: DataFrame, p: InferenceParams = InferenceParams()) -> DataFrame:
    """file, ProteinGroup, PeptideSequence, Class, TargetScore, DecoyScore, QValue: the table that each file gets.

    ``psms``: file, sequence (modified), score; ``classes`` as from ``peptide_classes``; ``decoy_peptides`` as from ``reversed_peptides``. A file
    has the groups of which it holds a peptide, with its own peptides of them. Decoy proteins that are in no group count for
    the q-values and are left out of the table. Repeated rows count once (of a sequence the best score does); no rows: no groups.
    """
    if p.q_value not in ("storey", None):
        raise ValueError(p.q_value)
    keys = [] if p.group_files else ["file"]
    found = cut(classified(peptide_scores(psms, "sequence", "score", ["file"]), classes))
    decoys = cut(digested_scores(decoy_peptides, found, keys))
    own = _own(found, keys, p)
    # Dealt by group once, for the best scores of its sequences and for their sum.
    best = own.repartition(*keys, "protein_group").groupBy(*keys, "protein_group", "class", "sequence").agg(F.max("score").alias("score"))
    groups = best.groupBy(*keys, "protein_group").agg(F.min("class").alias("class"), F.sum("score").alias("target_score"))
    scored = with_decoy_only(cut(with_decoy_scores(groups, decoys, keys)), decoys, keys)
    rated = group_q_values(scored, keys) if p.q_value else scored.withColumn("q_value", F.lit(None).cast("double"))
    here = own.groupBy("file", "protein_group").agg(F.array_join(F.array_sort(F.collect_set("sequence")), ";").alias("PeptideSequence"))
    out = here.join(rated.where("NOT decoy"), [*keys, "protein_group"])
    return out.select("file", F.col("protein_group").alias("ProteinGroup"), "PeptideSequence", F.col("class").alias("Class"), F.col("target_score").alias("TargetScore"), F.col("decoy_score").alias("DecoyScore"), F.col("q_value").alias("QValue"))


def _own(found: DataFrame, keys: list[str], p: InferenceParams) -> DataFrame:
    """file, protein_group, class, sequence, score: the rows of ``found`` that each group has by its usage. By default these are ``found`` itself."""
    if (p.usage, p.strictness) == ("minimal", "maximal"):
        return found
    groups = grouped(found.select(*keys, "sequence", "protein_group", "class").distinct(), keys, p.usage, p.strictness)
    rows = groups.select(*keys, "protein_group", "class", F.explode(F.split("peptides", ";")).alias("sequence"))
    return cut(rows.join(found.select("file", "sequence", "score"), [*keys, "sequence"]).select("file", "protein_group", "class", "sequence", "score"))


def infer_from_database(psms: DataFrame, proteins: DataFrame, pairs: DataFrame, p: InferenceParams = InferenceParams(), locus: Column | None = None) -> DataFrame:
    """``infer_proteins`` from a peptide database: ``proteins``: protein, sequence (and ``locus``, each its own without one); ``pairs``: peptide, protein."""
    known = proteins.select("protein", (F.col("protein") if locus is None else locus).alias("locus"), "sequence")
    return infer_proteins(psms, peptide_classes(pairs, known), reversed_peptides(proteins, p), p)
