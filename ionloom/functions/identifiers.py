"""Columns over identifiers, sequences, label channels and cells of the tools' tables. All stay inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Evidence classes of protein groups in order, and the number that stands for each.
EVIDENCE_CLASSES = {"Unknown": 0, "C1a": 1, "C1b": 2, "C2a": 3, "C2b": 4, "C3a": 5, "C3b": 6}
#: Terms of the proteomics ontology that mzTab names by number.
CV_TERMS = {
    "Sequest": "[MS, MS:1001155, SEQUEST:xcorr, ]",
    "Andromeda": "[MS, MS:1002338, Andromeda:score, ]",
    "XTandem": "[MS, MS:1001331, X!Tandem:hyperscore, ]",
    "Percolator": "[MS, MS:1001492, percolator:score, ]",
    "QValue": "[MS, MS:1001491, percolator:Q value, ]",
    "PEPValue": "[MS, MS:1001493, percolator:PEP, ]",
    "Trypsin": "[MS, MS:1001251, Trypsin, ]",
    "LysC": "[MS, MS:1001309, Lys-C, ]",
    "Carbamidomethylation": "[UNIMOD, UNIMOD:4, Carbamidomethyl, ]",
    "Oxidation": "[UNIMOD, UNIMOD:35, Oxidation, ]",
    "Acetylation": "[UNIMOD, UNIMOD:1, Acetyl, ]",
    "Phosphorylation": "[UNIMOD, UNIMOD:21, Phospho, ]",
}


def quant_source(c: Column) -> Column:
    """``PSM`` is that; anything else, missing cells included, is ``Alignment``."""
    return F.when(c == "PSM", "PSM").otherwise("Alignment")


def evidence_class(c: Column) -> Column:
    """A known evidence class, else ``Unknown``."""
    return F.when(c.isin(*EVIDENCE_CLASSES), c).otherwise("Unknown")


def evidence_ordinal(c: Column) -> Column:
    """The number of an evidence class; a text that is none is an error."""
    table = F.create_map(*[F.lit(x) for kv in EVIDENCE_CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.raise_error(F.concat(F.lit("evidence class "), F.coalesce(c, F.lit("null")))).cast("int"))


def restored_psm_id(c: Column) -> Column:
    """The text before the first ``_``, its ``-`` read as spaces."""
    return F.replace(F.substring_index(c, "_", 1), F.lit("-"), F.lit(" "))


def protein_id(c: Column, pattern: str) -> Column:
    """The first match of ``pattern``, null without one; the keyword ``id`` takes the text as it is."""
    return c if pattern == "id" else F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def flanking(sequence: Column, start: Column, end: Column, decoy: Column) -> Column:
    """struct<before, after>: residues around positions start to end (from 0, end included), ``-`` at the ends of the protein.

    A decoy is its peptide reversed, so its residues change sides.
    """
    before = F.when(start > 0, F.substring(sequence, start, F.lit(1))).otherwise("-")
    after = F.when(end + 1 < F.length(sequence), F.substring(sequence, end + 2, F.lit(1))).otherwise("-")
    pair = lambda a, b: F.struct(a.alias("before"), b.alias("after"))
    return F.when(decoy, pair(after, before)).otherwise(pair(before, after))


def decoy_sequence(sequence: Column) -> Column:
    """A sequence read backwards."""
    return F.reverse(sequence)


def target(light: Column, heavy: Column, global_mod: Column) -> Column:
    """The channel that an ion was identified in: light for GlobalMod 0, else heavy."""
    return F.when(global_mod == 0, light).otherwise(heavy)


def param(params: Column, at: int) -> Column:
    """A fit parameter by position (1 scan time, 2 standard deviation); missing where the fit has fewer, or NaN."""
    v = F.get(params, F.lit(at))
    return F.when(~F.isnan(v), v)


def scan_range(low: Column, high: Column) -> Column:
    """struct<low, high> widened to whole tens."""
    return F.struct((F.floor(F.round(low) / 10) * 10).alias("low"), (F.ceil(F.round(high) / 10) * 10).alias("high"))


def charges_or_default(charges: Column) -> Column:
    """The charges found, 2 and 3 where none was."""
    return F.when(F.size(charges) > 0, charges).otherwise(F.array(F.lit(2), F.lit(3)))


def time_difference(search: Column, fitted: Column) -> Column:
    """Search time less fitted time; missing if either is missing or NaN."""
    known = lambda c: F.when(~F.isnan(c), c)
    return known(search) - known(fitted)


def chosen_time(search: Column, fitted: Column, window: float) -> Column:
    """The fitted time if it is known and within ``window`` of the search time, else the search time."""
    return F.when(F.abs(time_difference(search, fitted)) < window, fitted).otherwise(search)


def refined_mz(theoretical: Column, measured: Column, correction: Column, sd: Column) -> Column:
    """Measured m/z; where it strays from the run's correction by over four deviations, theoretical m/z plus correction."""
    stray = F.abs(F.abs(correction) - F.abs(theoretical - measured)) > 4 * sd
    return F.when(stray, theoretical + correction).otherwise(measured)


def cv_param(term: Column) -> Column:
    """The ontology text of a term by name, null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CV_TERMS.items() for x in kv]), term)


def logit(p: Column) -> Column:
    """log10 of the odds; missing at 0 and 1 and outside."""
    return F.when((p > 0) & (p < 1), F.log10(p / (1 - p)))


def repaired_line(line: Column) -> Column:
    """A source line without the entity that some converters leave in attributes."""
    return F.replace(line, F.lit("&quot"), F.lit(""))


def or_empty(array: Column, kind: str) -> Column:
    """A null list read as an empty one of type ``kind``."""
    return F.coalesce(array, F.array().cast(kind))


def within_tolerance(intensities: Column, deltas: Column, tolerance: float = 0.05) -> Column:
    """Sum of the intensities whose distance is below ``tolerance``."""
    pairs = F.filter(F.arrays_zip(intensities.alias("i"), deltas.alias("d")), lambda p: F.abs(p["d"]) < tolerance)
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["i"])


def array_median(a: Column) -> Column:
    """Median of an array's known values, null if there is none."""
    v = F.sort_array(F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(v)
    middle = lambda i: F.get(v, F.floor(i).cast("int"))
    return F.when(n > 0, (middle((n - 1) / 2) + middle(n / 2)) / 2)


def safe_name(name: str) -> str:
    """A column name with anything but letters, digits and ``_`` replaced."""
    return re.sub(r"\W", "_", name)
