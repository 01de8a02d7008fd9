"""Monoisotopic masses and fragment ions of peptides as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import PROTON

WATER = 18.010565
#: Monoisotopic residue masses in Da.
RESIDUES = {
    "A": 71.037114, "C": 103.009185, "D": 115.026943, "E": 129.042593, "F": 147.068414, "G": 57.021464, "H": 137.058912,
    "I": 113.084064, "K": 128.094963, "L": 113.084064, "M": 131.040485, "N": 114.042927, "P": 97.052764, "Q": 128.058578,
    "R": 156.101111, "S": 87.032028, "T": 101.047679, "V": 99.068414, "W": 186.079313, "Y": 163.063329,
}


def residue_masses(sequence: Column) -> Column:
    """array<double>; an unknown residue has no mass."""
    table = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    return F.transform(F.filter(F.split(sequence, ""), lambda r: r != ""), lambda r: F.try_element_at(table, r))


def peptide_mass(sequence: Column) -> Column:
    """Neutral mass; missing if the sequence is empty or holds an unknown residue."""
    total = F.aggregate(residue_masses(sequence), F.lit(WATER), lambda s, x: s + x)
    return F.when(sequence != "", total)


def fragments(sequence: Column) -> Column:
    """array<struct<series, number, mz>> of the singly charged b and y ions; empty where the mass is unknown."""
    none = F.array().cast("array<double>")
    sums = F.aggregate(residue_masses(sequence), none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + x)))

    def ions(p: Column) -> Column:
        n = F.size(p)
        at = F.sequence(F.lit(1), n - 1)
        ion = lambda series, i, mz: F.struct(F.lit(series).alias("series"), i.alias("number"), mz.alias("mz"))
        b = F.transform(at, lambda i: ion("b", i, F.get(p, i - 1) + PROTON))
        y = F.transform(at, lambda i: ion("y", i, F.get(p, n - 1) - F.get(p, n - i - 1) + (WATER + PROTON)))
        return F.concat(b, y)

    # The sums are computed once, as the only element of an array.
    made = F.get(F.transform(F.array(sums), ions), F.lit(0))
    known = peptide_mass(sequence).isNotNull() & (F.length(sequence) > 1)
    return F.when(known, made).otherwise(F.array().cast("array<struct<series:string,number:int,mz:double>>"))


#: What each series adds to the residues of its end, in Da, and whether it starts at the first residue.
SERIES = {"a": (-27.994915, True), "b": (0.0, True), "c": (17.026549, True), "x": (25.979265 + WATER, False), "y": (WATER, False), "z": (WATER - 17.026549, False)}


def ladders(sequence: Column, series: str = "by", charges: tuple[int, ...] = (1,)) -> Column:
    """array<struct<series, number, charge, mz>> of all ions of the series at the charges; empty where the mass is unknown."""
    none = F.array().cast("array<struct<series:string,number:int,charge:int,mz:double>>")
    sums = F.aggregate(residue_masses(sequence), F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def ions(p: Column) -> Column:
        n = F.size(p) - 1
        out = []
        for s in series:
            shift, first = SERIES[s]
            mass = (lambda i: F.get(p, i) + shift) if first else (lambda i: F.get(p, n) - F.get(p, n - i) + shift)  # noqa: B023
            for z in charges:
                out.append(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.lit(s).alias("series"), i.alias("number"), F.lit(z).alias("charge"), (mass(i) / z + PROTON).alias("mz"))))  # noqa: B023
        return F.concat(*out)

    known = peptide_mass(sequence).isNotNull() & (F.length(sequence) > 1)
    return F.when(known, F.get(F.transform(F.array(sums), ions), F.lit(0))).otherwise(none)
