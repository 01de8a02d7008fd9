"""mzTab text: metadata lines and protein, peptide and PSM tables with one column per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import lookup_or_fail

#: Line prefixes of header and rows of each section, in file order.
SECTIONS = {"protein": ("PRH", "PRT"), "peptide": ("PEH", "PEP"), "psm": ("PSH", "PSM")}


def metadata_lines(values: dict[str, object]) -> list[str]:
    """``MTD`` lines. A list value numbers its key, which holds ``[%i]``; null values are left out."""
    out = []
    for key, value in values.items():
        for i, v in enumerate(value if isinstance(value, list) else [value], 1):
            if v is not None:
                out.append(f"MTD\t{key.replace('[%i]', f'[{i}]')}\t{v}")
    return out


def section_lines(df: DataFrame, kind: str, sort: list[str]) -> DataFrame:
    """sort key and line of every row of a section; missing values and NaN are written ``null``."""
    cell = lambda c: F.when(F.col(f"`{c}`").cast("string") == "NaN", "null").otherwise(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")))
    clean = lambda c: F.regexp_replace(cell(c), r"[\t\r\n]", " ")
    key = F.to_json(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sort]))
    return df.select(key.alias("key"), F.concat_ws("\t", F.lit(SECTIONS[kind][1]), *map(clean, df.columns)).alias("line"))


def mztab_lines(spark: SparkSession, metadata: dict[str, object], sections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """part, key, line of a whole file: metadata, then the sections given, each a frame and its sort columns."""
    out = spark.createDataFrame([(0, f"{i:06d}", line) for i, line in enumerate([*metadata_lines(metadata), ""])], "part int, key string, line string")
    for at, kind in enumerate(SECTIONS):
        if kind in sections:
            df, sort = sections[kind]
            head = spark.createDataFrame([(10 * at + 1, "", "\t".join([SECTIONS[kind][0], *df.columns])), (10 * at + 3, "", "")], "part int, key string, line string")
            out = out.unionByName(head).unionByName(section_lines(df, kind, sort).withColumn("part", F.lit(10 * at + 2)))
    return out


def numbered(runs: list[str], spark: SparkSession) -> DataFrame:
    """run, run_no: runs numbered from 1 in the order given."""
    return spark.createDataFrame([(r, i) for i, r in enumerate(runs, 1)], "run string, run_no int")


def aligned(tab: DataFrame, prot: DataFrame, quant: DataFrame, psms: DataFrame) -> DataFrame:
    """One row per (run, protein, ion, PSM): table rows met with their protein group, its ions and their identifications.

    ``tab``: run, protein; ``prot``: run, protein_group, peptides (both ``;``-joined); ``quant``: run, sequence, mod_id, charge and more;
    ``psms``: run, mod_id, charge and more. A table row without a protein group is an error.
    """
    groups = prot.withColumn("protein", F.explode(F.split("protein_group", ";")))
    met = lookup_or_fail(tab, groups, ["run", "protein"], ["protein_group", "peptides"])
    peptides = met.withColumn("sequence", F.explode(F.split("peptides", ";"))).drop("peptides")
    return peptides.join(quant, ["run", "sequence"]).join(psms, ["run", "mod_id", "charge"])


def study_averages(rows: DataFrame, keys: list[str], members: DataFrame, values: list[str]) -> DataFrame:
    """keys, study, and of each value the mean, deviation and error of the mean over the runs of a study variable; without runs null.

    ``rows``: keys, run, values; ``members``: study, run.
    """
    cols = [c for v in values for c in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_stdev"), F.try_divide(F.stddev_samp(v), F.sqrt(F.count(v))).alias(f"{v}_sem"))]
    return rows.join(members, "run").groupBy(*keys, "study").agg(*cols)


def by_number(rows: DataFrame, keys: list[str], number: str, count: int, values: dict[str, str]) -> DataFrame:
    """One row per key with a column per number from 1 to ``count``: ``values`` maps a template that holds ``[%i]`` to a column; absent: null."""
    return rows.groupBy(*keys).agg(*[F.first(F.when(F.col(number) == i, F.col(c)), ignorenulls=True).alias(t.replace("[%i]", f"[{i}]")) for t, c in values.items() for i in range(1, count + 1)])


def protein_section(proteins: DataFrame, runs: list[str], studies: dict[str, list[str]]) -> DataFrame:
    """accession, ambiguity_members, abundances by run, and by study the means of runs' values, deviations and errors.

    ``proteins``: run, protein_group, quant, stdev, sem.
    """
    spark = proteins.sparkSession
    base = proteins.withColumn("accession", F.element_at(F.split("protein_group", ";"), 1)).withColumn("ambiguity_members", F.array_join(F.slice(F.split("protein_group", ";"), 2, 1000000), ","))
    keys = ["accession", "ambiguity_members"]
    wide = by_number(base.join(F.broadcast(numbered(runs, spark)), "run"), keys, "run_no", len(runs), {"protein_abundance_assay[%i]": "quant"})
    members = spark.createDataFrame([(n, r) for n, rs in enumerate(studies.values(), 1) for r in rs], "study int, run string")
    per = base.join(F.broadcast(members), "run").groupBy(*keys, "study").agg(F.avg("quant").alias("q"), F.avg("stdev").alias("d"), F.avg("sem").alias("e"))
    of = by_number(per, keys, "study", len(studies), {"protein_abundance_study_variable[%i]": "q", "protein_abundance_stdev_study_variable[%i]": "d", "protein_abundance_std_error_study_variable[%i]": "e"})
    return wide.join(of, keys, "left")


def peptide_section(ions: DataFrame, runs: list[str], score: str, q_value: bool = True) -> DataFrame:
    """sequence, charge, global_mod, best score (least for q-values, else greatest), and score and abundance by run.

    ``ions``: run, sequence, charge, global_mod, quant and ``score``.
    """
    keys, best = ["sequence", "charge", "global_mod"], F.min if q_value else F.max
    rows = ions.groupBy(*keys, "run").agg(best(score).alias("__s"), F.sum("quant").alias("__q")).join(F.broadcast(numbered(runs, ions.sparkSession)), "run")
    top = ions.groupBy(*keys).agg(best(score).alias("best_search_engine_score[1]"))
    return top.join(by_number(rows, keys, "run_no", len(runs), {"search_engine_score[1]_ms_run[%i]": "__s", "peptide_abundance_assay[%i]": "__q"}), keys)


def psm_section(psms: DataFrame, key: str = "psm_id") -> DataFrame:
    """``psms`` one row each; an id with several rows is an error when read."""
    twice = psms.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    rows = psms.join(twice, F.col(key) == F.col("__k"))
    clash = F.raise_error(F.concat(F.lit("several rows of PSM "), F.col(key).cast("string"))).cast("boolean")
    return rows.where(F.when(F.col("__n") == 1, True).otherwise(clash)).select(*psms.columns)


def write_mztab(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text parts under ``path`` whose names sort in file order: their concatenation is the mzTab file."""
    lines.orderBy("part", "key", "line").select("line").write.mode(mode).text(path)
