"""The peptide database as four Parquet tables: build, scans and lookups.

Tables: ``protein`` (ID, Accession, Sequence), ``pepsequence`` (ID, Sequence), ``cleavage`` (ProteinID, PepSequenceID,
CleavageStart, CleavageEnd, MissCleavages) and ``modsequence`` (ID, PepSequenceID, RealMass, Sequence, GlobalMod), the last sorted
by (Sequence, GlobalMod) within its files, which stands for an index: a lookup reads the row groups whose range fits. A fifth,
``by_mass``, holds ``modsequence`` in folders of ``mass_cell`` (RealMass in steps of some Da): a search reads the folders of its precursors alone.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import digest
from ..functions.masses import peptide_mass
from ..operators.grid import Axis, grid_join

TABLES = ("protein", "pepsequence", "cleavage", "modsequence")
#: Mass shifts in Da of modifications by the tag that marks them in a sequence, and the residues they stand on.
MODIFICATIONS = {"ac": (42.010565, "N-term"), "ph": (79.966331, "STY"), "ox": (15.994915, "M"), "cm": (57.021464, "C"), "me": (14.015650, "KR"), "de": (0.984016, "NQ")}
#: Mass shifts in Da of an atom's heavy isotope by the label's number in GlobalMod, and the atom.
LABELS = {1: (0.997035, "N"), 2: (1.003355, "C")}


@dataclass(frozen=True)
class SearchParams:
    protease: str = "trypsin"
    max_missed: int = 2
    min_length: int = 4
    max_length: int = 40
    variable: tuple[str, ...] = ("ox",)
    max_variable: int = 2
    labels: tuple[int, ...] = (0, 1)


def _nitrogens(sequence: Column) -> Column:
    more = {"R": 3, "H": 2, "K": 1, "N": 1, "Q": 1, "W": 1}
    return F.length(sequence) + sum((F.length(sequence) - F.length(F.replace(sequence, F.lit(r), F.lit("")))) * n for r, n in more.items())


def _modified(sequence: Column, p: SearchParams) -> Column:
    """array<struct<s, shift>>: the sequence and its forms with up to ``max_variable`` modified residues, tags after residues."""
    form = lambda s, shift, n: F.named_struct(F.lit("s"), s, F.lit("shift"), shift, F.lit("n"), n)
    start = F.array(form(F.lit(""), F.lit(0.0), F.lit(0)))

    def grow(acc: Column, r: Column) -> Column:
        forms = [F.transform(acc, lambda x: form(F.concat(x["s"], r), x["shift"], x["n"]))]
        for tag in p.variable:
            mass, on = MODIFICATIONS[tag]
            some = F.filter(acc, lambda x: r.isin(*on) & (x["n"] < p.max_variable))  # noqa: B023
            forms.append(F.transform(some, lambda x: form(F.concat(x["s"], r, F.lit(f"[{tag}]")), x["shift"] + mass, x["n"] + 1)))  # noqa: B023
        return F.concat(*forms)

    return F.aggregate(F.filter(F.split(sequence, ""), lambda r: r != ""), start, grow)


def build(proteins: DataFrame, p: SearchParams = SearchParams()) -> dict[str, DataFrame]:
    """The four tables from ``proteins`` (Accession, Sequence). Ids are hashes, so that no numbering passes through one task."""
    named = proteins.select(F.xxhash64("Accession").alias("ID"), "Accession", F.upper("Sequence").alias("Sequence"))
    cuts = named.select(F.col("ID").alias("ProteinID"), F.explode(digest(F.col("Sequence"), p.protease, p.max_missed)).alias("d"))
    cuts = cuts.select("ProteinID", F.col("d.peptide").alias("Sequence"), F.col("d.start").alias("CleavageStart"), (F.col("d.start") + F.length("d.peptide") - 1).alias("CleavageEnd"), F.col("d.missed").alias("MissCleavages"))
    cuts = cuts.where(F.length("Sequence").between(p.min_length, p.max_length)).withColumn("PepSequenceID", F.xxhash64("Sequence"))
    peptides = cuts.select(F.col("PepSequenceID").alias("ID"), "Sequence").distinct()
    mods = peptides.select(F.col("ID").alias("PepSequenceID"), "Sequence", F.explode(_modified(F.col("Sequence"), p)).alias("m"), F.explode(F.array(*map(F.lit, p.labels))).alias("GlobalMod"))
    label = F.coalesce(*[F.when(F.col("GlobalMod") == k, v[0] * (_nitrogens(F.col("Sequence")) if v[1] == "N" else F.length("Sequence"))) for k, v in LABELS.items()], F.lit(0.0))
    mods = mods.select(F.xxhash64("m.s", "GlobalMod").alias("ID"), "PepSequenceID", (peptide_mass(F.col("Sequence")) + F.col("m.shift") + label).alias("RealMass"), F.col("m.s").alias("Sequence"), "GlobalMod")
    return {"protein": named, "pepsequence": peptides, "cleavage": cuts.drop("Sequence"), "modsequence": mods}


def write(tables: dict[str, DataFrame], path: str, p: SearchParams = SearchParams(), mode: str = "errorifexists") -> None:
    """The tables and their parameters under ``path``."""
    for name in TABLES:
        df = tables[name]
        if name == "modsequence":
            df = df.repartitionByRange("Sequence", "GlobalMod").sortWithinPartitions("Sequence", "GlobalMod")
        df.write.mode(mode).parquet(f"{path}/{name}")
    spark = tables["protein"].sparkSession
    spark.createDataFrame([(json.dumps(asdict(p)),)], "params string").write.mode(mode).parquet(f"{path}/params")


def read(spark: SparkSession, path: str, keep: bool = False) -> dict[str, DataFrame]:
    """The tables by name; ``keep`` holds them in the executors' memory and disk for many lookups."""
    out = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return {k: v.cache() for k, v in out.items()} if keep else out


#: Da of mass in one folder of ``by_mass``: folders are as many as the range of masses has cells, whatever the rows.
MASS_CELL = 5.0


def write_by_mass(modsequence: DataFrame, path: str, cell: float = MASS_CELL, mode: str = "errorifexists") -> None:
    """``modsequence`` under ``path``/by_mass in folders of mass cells, sorted by mass; rows without a mass are in none.

    Tasks are ranges of the mass itself, so a cell with a large share of all peptides is several files of several tasks.
    """
    rows = modsequence.where(F.col("RealMass").isNotNull() & ~F.isnan("RealMass")).withColumn("mass_cell", F.floor(F.col("RealMass") / cell).cast("int"))
    parts = int(modsequence.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "RealMass", "ID").sortWithinPartitions("mass_cell", "RealMass").write.mode(mode).partitionBy("mass_cell").parquet(f"{path}/by_mass")
    ends = rows.agg(F.lit(cell).alias("cell"), F.min("mass_cell").alias("first"), F.max("mass_cell").alias("last"))
    ends.write.mode(mode).parquet(f"{path}/by_mass_cells")


def mass_scan(windows: DataFrame, path: str, low: Column, high: Column) -> DataFrame:
    """The rows of ``by_mass`` whose cells the windows [``low``, ``high``] touch; no other folder is listed or read.

    The windows' distinct cells are found first and become the scan's partition filter. They are at most as many as the table
    has folders, as windows are cut to its range.
    """
    spark = windows.sparkSession
    size = spark.read.parquet(f"{path}/by_mass_cells").first()
    folders = spark.read.parquet(f"{path}/by_mass") if size["first"] is not None else None
    if folders is None:
        return spark.createDataFrame([], "ID bigint, PepSequenceID bigint, RealMass double, Sequence string, GlobalMod int")
    at = lambda c: F.floor(c.cast("double") / size["cell"]).cast("bigint")
    first, last = F.greatest(at(low), F.lit(size["first"])), F.least(at(high), F.lit(size["last"]))
    known = low.isNotNull() & high.isNotNull() & ~F.isnan(low.cast("double")) & ~F.isnan(high.cast("double"))
    touched = windows.where(known).select(first.alias("a"), last.alias("z")).where("a <= z").distinct()
    cells = [r["c"] for r in touched.select(F.explode(F.sequence("a", "z")).alias("c")).distinct().collect()]
    return folders.where(F.col("mass_cell").isin(sorted(cells)) if cells else F.lit(False)).drop("mass_cell")


def mass_candidates(precursors: DataFrame, path: str, low: Column, high: Column) -> DataFrame:
    """``precursors`` with every database row whose RealMass lies in [``low``, ``high``]: its ID, PepSequenceID, RealMass, Sequence, GlobalMod.

    Missing bounds have no candidates. Where the folders are read, precursors and rows meet by logarithmic cells of their mass.
    """
    return grid_join(precursors, mass_scan(precursors, path, low, high), [Axis(low, high, F.col("RealMass"), log=True)])


def with_decoys(candidates: DataFrame) -> DataFrame:
    """Each candidate twice: as it is, and as a decoy of its residues backwards, whose mass is the same; tags stay behind their residues."""
    residues = F.regexp_extract_all(F.col("Sequence"), F.lit(r"[A-Za-z](?:\[[a-z]+\])*"), F.lit(0))
    twice = candidates.withColumn("decoy", F.explode(F.array(F.lit(False), F.lit(True))))
    return twice.withColumn("Sequence", F.when(F.col("decoy"), F.array_join(F.reverse(residues), "")).otherwise(F.col("Sequence")))


def search_params(spark: SparkSession, path: str) -> SearchParams:
    """The parameters that a database was built with: one row of JSON."""
    d = json.loads(spark.read.parquet(f"{path}/params").first()["params"])
    return SearchParams(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})


def protein_scan(db: dict[str, DataFrame]) -> DataFrame:
    """All (Accession, Sequence)."""
    return db["protein"].select("Accession", "Sequence")


def _looked_up(keys: DataFrame, table: DataFrame, on: dict[str, str], columns: dict[str, Column]) -> DataFrame:
    """``keys`` with ``columns`` (name: value where nothing is found) of the row that has the key columns ``on``."""
    side = table.select(*[F.col(t).alias(f"__{k}") for k, t in on.items()], F.struct(*[F.col(c).alias(c) for c in columns]).alias("__r"))
    cond = [F.col(k) == F.col(f"__{k}") for k in on]
    met = keys.join(side, cond, "left")
    return met.select(*keys.columns, *[F.coalesce(F.col(f"__r.{c}"), none).alias(f"found_{c}") for c, none in columns.items()])


def protein_by_id(keys: DataFrame, db: dict[str, DataFrame], key: str) -> DataFrame:
    return _looked_up(keys, db["protein"], {key: "ID"}, {"Accession": F.lit(""), "Sequence": F.lit("")})


def peptide_by_id(keys: DataFrame, db: dict[str, DataFrame], key: str) -> DataFrame:
    return _looked_up(keys, db["pepsequence"], {key: "ID"}, {"Sequence": F.lit("")})


def modified_by_sequence(keys: DataFrame, db: dict[str, DataFrame], sequence: str, global_mod: str) -> DataFrame:
    """Modified sequence, ids and mass by (sequence, global modification); -1 and NaN where there is none."""
    none = F.lit(-1).cast("bigint")
    return _looked_up(keys, db["modsequence"], {sequence: "Sequence", global_mod: "GlobalMod"}, {"ID": none, "PepSequenceID": none, "RealMass": F.lit(float("nan"))})


def modified_by_id(keys: DataFrame, db: dict[str, DataFrame], key: str) -> DataFrame:
    none = F.lit(-1).cast("bigint")
    return _looked_up(keys, db["modsequence"], {key: "ID"}, {"PepSequenceID": none, "RealMass": F.lit(float("nan")), "Sequence": F.lit(""), "GlobalMod": F.lit(-1)})


def proteins_of_peptides(keys: DataFrame, db: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per (peptide id, protein): accession, peptide, cleavage positions, missed cleavages and the protein's sequence."""
    cut = db["cleavage"].select(F.col("PepSequenceID").alias(key), "ProteinID", "CleavageStart", "CleavageEnd", "MissCleavages")
    met = keys.select(key).distinct().join(cut, key)
    met = met.join(db["protein"].select(F.col("ID").alias("ProteinID"), "Accession", F.col("Sequence").alias("ProteinSequence")), "ProteinID")
    return met.join(db["pepsequence"].select(F.col("ID").alias(key), F.col("Sequence").alias("Peptide")), key).drop("ProteinID")


def enriched_psms(psms: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``psms`` (with ``key`` and ``Label``) with Before, After and ProteinNames of their peptide.

    The cleavage with fewest missed sites gives the flanks (ties: the lesser accession); all accessions are joined by ``;``,
    ``decoy_`` before each of a decoy's; ``noProt`` where the lookup has no row.
    """
    from ..functions.identifiers import flanking

    best = F.min(F.struct("MissCleavages", "Accession", "CleavageStart", "CleavageEnd", "ProteinSequence")).alias("b")
    per = lookup.groupBy(F.col(key).alias("__k")).agg(best, F.array_sort(F.collect_set("Accession")).alias("a"))
    decoy = F.col("Label") == -1
    f = flanking(F.col("b.ProteinSequence"), F.col("b.CleavageStart"), F.col("b.CleavageEnd"), decoy)
    names = F.array_join(F.transform("a", lambda x: F.when(decoy, F.concat(F.lit("decoy_"), x)).otherwise(x)), ";")
    met = psms.join(per, psms[key] == F.col("__k"), "left")
    return met.select(*psms.columns, F.coalesce(f["before"], F.lit("-")).alias("Before"), F.coalesce(f["after"], F.lit("-")).alias("After"), F.coalesce(names, F.lit("noProt")).alias("ProteinNames"))
