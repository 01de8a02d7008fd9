"""Whole tools as plans: protein-ion join, label-free and labeled quantification, deduced peptides, table sorting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import modification_ok, transform
from ..operators.aggregate import Channel, GroupFilter, grouped_values, pivot_runs, tested
from ..operators.frames import apply_level


def join_ions_with_proteins(quant: DataFrame, prot: DataFrame) -> DataFrame:
    """One row per (protein group, ion): a group's ``;``-joined peptides exploded and met with the ions by sequence."""
    peptides = prot.select("ProteinGroup", F.col("QValue").alias("ProteinGroup_QValue"), F.explode(F.split("PeptideSequence", ";")).alias("StringSequence"))
    return peptides.join(quant.drop("ProteinGroup", "ProteinGroup_QValue"), "StringSequence")


Channels = dict[str, Channel]
ION = ["FileName", "ProteinGroup", "StringSequence", "PepSequenceID", "ModSequenceID", "Charge", "GlobalMod"]
LIGHT = ("Quant_Light",)
BOTH = ("Quant_Light", "Quant_Heavy", "Ratio_LightByHeavy")


def plain(names: tuple[str, ...], agg: str = "mean") -> Channels:
    """One channel per quantity without a transform or filter."""
    return {n: Channel(n, agg=agg) for n in names}


@dataclass(frozen=True)
class Quantification:
    """How ions become proteins: a channel per quantity at every level; levels that are None are left out."""

    modified: tuple[str, ...] | None = ()
    all_peptides: bool = True
    max_alignment_q: float | None = None
    min_correlation: float | None = None
    global_mod: Channels = field(default_factory=lambda: plain(BOTH))
    charge: Channels | None = None
    modification: Channels | None = None
    protein: Channels | None = None


def channels_of(params: dict | None, names: tuple[str, ...]) -> Channels | None:
    """A level's channels from its entry in a parameter file (tagged unions already plain)."""
    if params is None:
        return None
    short = {"Quant_Light": "Light", "Quant_Heavy": "Heavy", "Ratio_LightByHeavy": "Ratio"}
    part = lambda kind, n: next((v.get(short[n]) for k, v in params.items() if k.endswith(kind) and isinstance(v, dict)), None)
    out = {}
    for n in names:
        bounds = dict(part("SingleFilters", n) or [])
        groups = tuple(GroupFilter(k.lower(), v) for k, v in part("GroupFilters", n) or [])
        t = part("Transform", n)
        name, operand = (t[0].lower(), t[1]) if isinstance(t, tuple) else ((t or "identity").lower(), 0.0)
        out[n] = Channel(n, name, bounds.get("IsBiggerThan"), bounds.get("IsSmallerThan"), groups, part("Aggregation", n).lower(), operand)
    return out


def quantification(params: dict, names: tuple[str, ...]) -> Quantification:
    """A tool's parameters from its file, see ``sources.tables.read_params``."""
    m = params.get("ModificationFilter", "All")
    return Quantification(
        modified=tuple(m[1]) if isinstance(m, tuple) else (),
        all_peptides=m == "All",
        max_alignment_q=params.get("Alignment_QValue"),
        min_correlation=params.get("Correlation_Light_Heavy_Threshold"),
        global_mod=channels_of(params.get("AggregateGlobalModificationsParams"), names) or plain(names),
        charge=channels_of(params.get("AggregatePeptideChargeStatesParams"), names),
        modification=channels_of(params.get("AggregateModifiedPeptidesParams"), names),
        protein=channels_of(params.get("AggregateToProteinGroupsParams"), names),
    )


def _ions(quant: DataFrame, p: Quantification) -> DataFrame:
    rows = quant if p.all_peptides else quant.where(modification_ok(F.col("StringSequence"), p.modified))
    if p.max_alignment_q is not None and "AlignmentQValue" in quant.columns:
        q = F.col("AlignmentQValue")
        rows = rows.where(q.isNull() | F.isnan(q) | (q < p.max_alignment_q))
    return rows


def _passing(rows: DataFrame, keys: list[str], channels: Channels) -> DataFrame:
    """``rows`` with transformed quantities. A row counts only if it passes the filters of all channels that have some."""
    rows = rows.withColumns({n: transform(F.col(c.column), c.transform, c.operand) for n, c in channels.items()})
    for n, c in channels.items():
        if c.above is not None or c.below is not None or c.group_filters:
            rows, passes = tested(rows, c, keys, n)
            rows = rows.withColumn("__in", F.col("__in") & F.col(passes)).drop(passes) if "__in" in rows.columns else rows.withColumnRenamed(passes, "__in")
    return rows.where("__in").drop("__in") if "__in" in rows.columns else rows


def _level(rows: DataFrame, keys: list[str], channels: Channels) -> DataFrame:
    """One row per key with each channel's aggregate and the group's first known q-value."""
    values = {n: (c.agg, n) for n, c in channels.items()}
    out = grouped_values(_passing(rows, keys, channels), keys, values, [F.first("ProteinGroup_QValue", ignorenulls=True).alias("ProteinGroup_QValue")])
    return out.where(F.coalesce(*channels).isNotNull())


def _proteins(rows: DataFrame, channels: Channels) -> DataFrame:
    """Per file and protein group: number, aggregate, CV, standard deviation and error of the mean of each quantity."""
    cols = []
    for n, c in channels.items():
        number, sd = F.count(n), F.stddev_samp(n)
        item, other = ("LightByHeavy", "Ratio") if n == "Ratio_LightByHeavy" else (n.split("_", 1)[1],) * 2
        cols += [number.cast("int").alias(f"ItemsUsedForQuant_{item}"), F.try_divide(sd, F.avg(n)).alias(f"CV_Quant_{other}"), sd.alias(f"StDev_Quant_{other}"), (sd / F.sqrt(number)).alias(f"SEM_Quant_{other}")]
    keys = ["FileName", "ProteinGroup"]
    out = grouped_values(_passing(rows, keys, channels), keys, {n: (c.agg, n) for n, c in channels.items()}, [F.first("ProteinGroup_QValue", ignorenulls=True).alias("ProteinGroup_QValue"), *cols])
    return out.where(F.coalesce(*channels).isNotNull())


def label_free_levels(quant: DataFrame, p: Quantification = Quantification()) -> dict[str, DataFrame]:
    """``charge``, ``modification`` (where asked for) and ``protein`` quantities per file from light ions."""
    out, rows, keys = {}, _ions(quant, p).where("GlobalMod = 0"), list(ION)
    for name, channels, gone in (("charge", p.charge, ("Charge", "GlobalMod")), ("modification", p.modification, ("StringSequence", "ModSequenceID"))):
        if channels is not None:
            keys = [k for k in keys if k not in gone]
            rows = out[name] = _level(rows, keys, {n: channels[n] for n in LIGHT})
    return out | {"protein": _proteins(rows, {n: (p.protein or plain(LIGHT))[n] for n in LIGHT})}


def label_free(quant: DataFrame, p: Quantification = Quantification()) -> DataFrame:
    return label_free_levels(quant, p)["protein"]


def labeled_levels(quant: DataFrame, p: Quantification = Quantification()) -> dict[str, DataFrame]:
    """``global``, ``charge``, ``modification`` and ``protein`` quantities of light, heavy and their ratio, whose per-ion value is made
    before anything is aggregated. Ions without a correlation take no part."""
    rows = _ions(quant, p).withColumn("Ratio_LightByHeavy", F.try_divide("Quant_Light", "Quant_Heavy"))
    c = F.col("Correlation_Light_Heavy")
    rows = rows.where(c > p.min_correlation if p.min_correlation is not None else c.isNotNull())
    keys = [k for k in ION if k not in ("GlobalMod", "ModSequenceID")]
    out = {"global": _level(rows, keys, p.global_mod)}
    rows = out["global"]
    for name, channels, gone in (("charge", p.charge, "Charge"), ("modification", p.modification, "StringSequence")):
        if channels is not None:
            keys = [k for k in keys if k != gone]
            rows = out[name] = _level(rows, keys, channels)
    return out | {"protein": _proteins(rows, p.protein or plain(BOTH))}


def labeled(quant: DataFrame, p: Quantification = Quantification()) -> DataFrame:
    return labeled_levels(quant, p)["protein"]


def by_file(proteins: DataFrame, files: list[str]) -> DataFrame:
    """One row per protein group with ``<file>.<column>`` of each file."""
    values = [c for c in proteins.columns if c not in ("FileName", "ProteinGroup")]
    return pivot_runs(proteins, ["ProteinGroup"], "FileName", files, values, ".")


def add_deduced_peptides(prot: DataFrame, quant: DataFrame) -> DataFrame:
    """Protein groups of each file with the peptides that file quantified of them, as any file's inference gives them.

    A group with differing scores between files is an error.
    """
    score = F.struct("Class", "TargetScore", "DecoyScore", "QValue")
    once = prot.groupBy("ProteinGroup").agg(F.count_distinct(score).alias("n"), F.first(score).alias("s"), F.array_distinct(F.flatten(F.collect_list(F.split("PeptideSequence", ";")))).alias("peps"))
    once = once.withColumn("peps", F.when(F.col("n") == 1, F.col("peps")).otherwise(F.raise_error(F.concat(F.lit("scores differ: "), "ProteinGroup")).cast("array<string>")))
    pairs = once.select("ProteinGroup", "s", F.posexplode("peps").alias("at", "StringSequence"))
    found = quant.select("FileName", "StringSequence").distinct().join(pairs, "StringSequence")
    out = found.groupBy("FileName", "ProteinGroup").agg(F.first("s").alias("s"), F.array_sort(F.collect_list(F.struct("at", "StringSequence"))).alias("p"))
    return out.select("FileName", "ProteinGroup", F.array_join("p.StringSequence", ";").alias("PeptideSequence"), "s.*")


def table_sort(prot: DataFrame, quant: DataFrame, columns: tuple[str, ...] = ("Quant_Light",), count: str = "Quant_Light", agg: str = "median", other: str = "mean", exceptions: tuple[str, ...] = ()) -> DataFrame:
    """Per experiment and single protein of its group: the number of distinct peptides with a value in ``count``, and ``columns`` by ``agg``
    (those in ``exceptions`` by ``other``) over the peptides.

    Ions become peptides first, by the same aggregates, so a peptide counts once however many ions it has.
    """
    single = prot.withColumn("Proteingroup", F.explode(F.split("ProteinGroup", ";"))).select("Experiment", "Proteingroup", F.explode(F.split("PeptideSequence", ";")).alias("StringSequence")).distinct()
    keys = ["Proteingroup", "Experiment"]
    peptides = apply_level(single.join(quant, ["Experiment", "StringSequence"]), [*keys, "StringSequence"], list(dict.fromkeys([*columns, count])), agg, other, exceptions)
    values = apply_level(peptides, keys, list(columns), agg, other, exceptions)
    return peptides.groupBy(*keys).agg(F.count(count).alias("DistinctPeptideCount")).join(values, keys)


def horizontal(table: DataFrame, experiments: list[str]) -> DataFrame:
    """The table of ``table_sort`` with one row per protein and ``<experiment>.<column>`` of each experiment."""
    values = [c for c in table.columns if c not in ("Proteingroup", "Experiment")]
    return pivot_runs(table, ["Proteingroup"], "Experiment", experiments, values, ".")
