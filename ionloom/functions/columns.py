"""Column builders: transforms, ratios, peptide strings, masses and array statistics. All stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PROTON = 1.007276466  # mass of a proton in Da
#: Cleavage rules as zero-width patterns.
PROTEASES = {
    "trypsin": r"(?<=[KR])(?!P)",
    "trypsin/p": r"(?<=[KR])",
    "lysc": r"(?<=K)(?!P)",
    "lysc/p": r"(?<=K)",
    "chymotrypsin": r"(?<=[FYWL])(?!P)",
    "pepsina": r"(?<=[FL])",
}
TRANSFORMS = {
    "log2": (F.log2, lambda c: F.pow(F.lit(2.0), c)),
    "log10": (F.log10, lambda c: F.pow(F.lit(10.0), c)),
    "ln": (F.ln, F.exp),
    "identity": (lambda c: c, lambda c: c),
}


def known(c: Column) -> Column:
    """NaN read as missing."""
    return F.when(~F.isnan(c), c)


def transform(c: Column, name: str, operand: float = 0.0) -> Column:
    """A numeric transform by name; logarithms of values of 0 or less are missing."""
    if name in TRANSFORMS:
        return TRANSFORMS[name][0](c)
    return {"add": c + operand, "subtract": c - operand, "multiply": c * operand, "divide": F.try_divide(c, F.lit(operand))}[name]


def inverse(c: Column, name: str) -> Column:
    return TRANSFORMS[name][1](c)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def within(c: Column, low: float | None = None, high: float | None = None, keep_missing: bool = True) -> Column:
    """Strictly inside optional bounds; missing values pass if ``keep_missing``."""
    inside = all_of([*([c > low] if low is not None else []), *([c < high] if high is not None else [])])
    missing = c.isNull()
    return missing | inside if keep_missing else ~missing & inside


def modification_ok(sequence: Column, allowed: tuple[str, ...] | None) -> Column:
    """No bracketed tag, or (with ``allowed``) only tags of that list."""
    if allowed is None:
        return ~F.contains(sequence, F.lit("["))
    tags = F.regexp_extract_all(sequence, F.lit(r"\[(\w*)\]"), F.lit(1))
    return F.forall(tags, lambda t: t.isin(*allowed)) if allowed else F.size(tags) == 0


def bare_sequence(sequence: Column) -> Column:
    return F.regexp_replace(sequence, r"[\p{Ll}\[\]]", "")


def digest(sequence: Column, protease: str = "trypsin", max_missed: int = 2) -> Column:
    """array<struct<peptide, start, missed>> of all runs of up to ``max_missed`` + 1 neighbouring fragments."""
    # Fragments and their starts are computed once for a sequence, not again for each fragment and run.
    return once(F.filter(F.split(sequence, PROTEASES[protease]), lambda s: s != ""), lambda parts: once(_starts(parts), lambda starts: _runs(parts, starts, max_missed)))


def _starts(parts: Column) -> Column:
    """Number of characters before each part: a running sum that keeps the array so far and its last value."""
    seed = F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("n"))
    return F.aggregate(parts, seed, lambda acc, s: F.struct(F.concat(acc["a"], F.array(acc["n"])).alias("a"), (acc["n"] + F.length(s)).alias("n")), lambda acc: acc["a"])


def _runs(parts: Column, starts: Column, max_missed: int) -> Column:
    def runs(m: int) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i + m < F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i + 1, m + 1), "").alias("peptide"), F.get(starts, i).alias("start"), F.lit(m).alias("missed")))

    some = F.concat(*[runs(m) for m in range(max_missed + 1)])
    return F.when(F.size(parts) > 0, some).otherwise(F.array().cast("array<struct<peptide:string,start:int,missed:int>>"))


def to_mz(mass: Column, charge: Column) -> Column:
    return mass / charge + PROTON


def to_mass(mz: Column, charge: Column) -> Column:
    return (mz - PROTON) * charge


def ppm(value: Column, tolerance: float) -> Column:
    """Half width of a window of ``tolerance`` parts per million."""
    return F.abs(value) * (tolerance * 1e-6)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not for each element of the arrays that ``body`` goes over."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_sum(a: Column) -> Column:
    """Shares of the array's sum; a zero sum gives missing shares."""
    return once(total(a), lambda s: F.transform(a, lambda x: F.try_divide(x.cast("double"), s)))


def kl_divergence(p: Column, q: Column) -> Column:
    terms = F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(F.lit(0.0)))
    return total(terms)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def mean_of(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; missing if either does not vary."""

    def centred(m: Column) -> Column:
        ab = total(F.zip_with(a, b, lambda x, y: (x - m["a"]) * (y - m["b"])))
        aa, bb = total(F.transform(a, lambda x: (x - m["a"]) * (x - m["a"]))), total(F.transform(b, lambda y: (y - m["b"]) * (y - m["b"])))
        return F.try_divide(ab, F.sqrt(aa * bb))

    return once(F.struct(mean_of(a).alias("a"), mean_of(b).alias("b")), centred)


def z_scores(a: Column) -> Column:
    """Each value less the mean, over the deviation; missing where there is none."""
    spread = lambda m: F.struct(m.alias("m"), F.sqrt(F.try_divide(total(F.transform(a, lambda x: (x - m) * (x - m))), F.size(a) - 1)).alias("sd"))
    return once(once(mean_of(a), spread), lambda s: F.transform(a, lambda x: F.try_divide(x - s["m"], s["sd"])))


def canonical_group(c: Column) -> Column:
    """Members of a ``;``-joined group without quotes, sorted and joined again."""
    return F.array_join(F.array_sort(F.split(F.regexp_replace(c, '"', ""), ";")), ";")
