"""Spectra: peptide scores, charge states, isotope patterns, label efficiency and centroids."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masses import fragments, peptide_mass
from .joins import range_join

ISOTOPE_GAP = 1.00335  # Da between carbon isotopes
#: Isotope abundances by added neutrons.
ISOTOPES = {"C": (0.9893, 0.0107), "H": (0.999885, 0.000115), "N": (0.99636, 0.00364), "O": (0.99757, 0.00038, 0.00205), "S": (0.9499, 0.0075, 0.0425, 0.0, 0.0001)}
#: Atoms C, H, N, O, S of each residue.
ATOMS = {
    "A": (3, 5, 1, 1, 0), "C": (3, 5, 1, 1, 1), "D": (4, 5, 1, 3, 0), "E": (5, 7, 1, 3, 0), "F": (9, 9, 1, 1, 0), "G": (2, 3, 1, 1, 0), "H": (6, 7, 3, 1, 0),
    "I": (6, 11, 1, 1, 0), "K": (6, 12, 2, 1, 0), "L": (6, 11, 1, 1, 0), "M": (5, 9, 1, 1, 1), "N": (4, 6, 2, 2, 0), "P": (5, 7, 1, 1, 0), "Q": (5, 8, 2, 2, 0),
    "R": (6, 12, 4, 1, 0), "S": (3, 5, 1, 2, 0), "T": (4, 7, 1, 2, 0), "V": (5, 9, 1, 1, 0), "W": (11, 10, 2, 1, 0), "Y": (9, 9, 1, 2, 0),
}


def cross_correlation_base(mz: np.ndarray, intensity: np.ndarray, width: float = 1.0005, size: int | None = None) -> np.ndarray:
    """Binned spectrum prepared for cross-correlation (Eng 1994): root intensities, ten windows scaled to 50, the mean of
    75 bins on both sides taken off."""
    at = (np.asarray(mz) / width).astype(int)
    ok = (at >= 0) & (np.asarray(intensity) > 0)
    # As many bins as the spectrum needs, and the reach of the mean beyond; ``size`` sets another number.
    y = np.zeros(size if size is not None else int(at[ok].max(initial=0)) + 76)
    ok &= at < len(y)
    np.maximum.at(y, at[ok], np.sqrt(np.asarray(intensity)[ok]))
    used = int(at[ok].max()) + 1 if ok.any() else 0
    step = max(1, -(-used // 10))
    for a in range(0, used, step):
        top = y[a : a + step].max()
        if top > 0:
            y[a : a + step] *= 50 / top
    c = np.concatenate([[0.0], np.cumsum(np.pad(y, 75))])
    return y - (c[151:] - c[:-151] - y) / 150


def cross_correlation(base: np.ndarray, ions: np.ndarray, width: float = 1.0005) -> float:
    at = np.unique((np.asarray(ions) / width).astype(int))
    return float(base[at[(at >= 0) & (at < len(base))]].sum() / 1e4)


def matched(mz: np.ndarray, ions: np.ndarray, tolerance: float) -> np.ndarray:
    """Index into sorted ``mz`` of the peak nearest to each ion, -1 where none is within ``tolerance``."""
    if not len(mz):
        return np.full(len(ions), -1)
    right = np.clip(np.searchsorted(mz, ions), 0, len(mz) - 1)
    left = np.maximum(right - 1, 0)
    best = np.where(np.abs(mz[left] - ions) <= np.abs(mz[right] - ions), left, right)
    return np.where(np.abs(mz[best] - ions) <= tolerance, best, -1)


def binomial_score(mz: np.ndarray, intensity: np.ndarray, ions: np.ndarray, tolerance: float, most: int = 10) -> float:
    """-10 log10 of the chance of so many matches (Cox 2011), at the best number of peaks kept per 100 Da."""
    if not len(mz) or not len(ions):
        return 0.0
    window = (mz // 100).astype(int)
    order = np.lexsort((-intensity, window))
    rank = np.empty(len(mz), int)
    first = np.concatenate([[True], np.diff(window[order]) != 0])
    rank[order] = np.arange(len(mz)) - np.maximum.accumulate(np.where(first, np.arange(len(mz)), 0))
    best, n = 0.0, len(ions)
    log = [math.lgamma(i + 1) for i in range(n + 1)]
    for q in range(1, most + 1):
        k = int((matched(mz[rank < q], ions, tolerance) >= 0).sum())
        p = min(0.999, q * 2 * tolerance / 100)
        terms = [log[n] - log[j] - log[n - j] + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k, n + 1)]
        top = max(terms)
        best = max(best, -10 * (top + math.log(sum(math.exp(t - top) for t in terms))) / math.log(10))
    return best


def hyperscore(intensity: np.ndarray, hits_b: np.ndarray, hits_y: np.ndarray) -> float:
    """log10 of the matched intensity times the factorials of the numbers of matches (Craig and Beavis 2004)."""
    b, y = hits_b[hits_b >= 0], hits_y[hits_y >= 0]
    total = intensity[b].sum() + intensity[y].sum()
    return float((math.log(total) + math.lgamma(len(b) + 1) + math.lgamma(len(y) + 1)) / math.log(10)) if total > 0 else 0.0


def score_spectra(spectra: DataFrame, peptides: DataFrame, mass_tolerance: float, fragment_tolerance: float) -> DataFrame:
    """spectrum, sequence, decoy and three scores of every peptide and reversed peptide of fitting mass, with the share by
    which the best cross-correlation of the spectrum exceeds this one.

    ``spectra``: spectrum, mass, mz, intensity; ``peptides``: sequence. Candidates come from a bucketed range join of
    masses alone; peaks join them afterwards and stay in Arrow batches. Peptides without a mass have no candidates.
    """
    both = peptides.select("sequence", F.lit(False).alias("decoy")).union(peptides.select(F.reverse("sequence"), F.lit(True))).distinct()
    both = both.withColumn("pep_mass", peptide_mass(F.col("sequence")))
    m = F.col("mass")
    found = range_join(spectra.select("spectrum", "mass"), both, m - mass_tolerance, m + mass_tolerance, F.col("pep_mass"), 2 * mass_tolerance)
    return score_candidates(spectra, found, fragment_tolerance)


def score_candidates(spectra: DataFrame, found: DataFrame, fragment_tolerance: float) -> DataFrame:
    """``score_spectra`` for the candidates ``found`` (spectrum, sequence, decoy), as a search of a mass-ordered database finds them."""
    rows = found.select("spectrum", "sequence", "decoy", fragments(F.col("sequence")).alias("ions")).join(spectra.select("spectrum", "mz", "intensity"), "spectrum")
    kind = spectra.schema["spectrum"].dataType.simpleString()
    ion = lambda s: F.transform(F.filter("ions", lambda i: i["series"] == s), lambda i: i["mz"]).alias(s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ready = None, None
        for part in batches:
            out = []
            for spectrum, seq, decoy, b, y, mz, it in part.itertuples(index=False):
                if ready is None or spectrum != key:
                    mz, it = np.asarray(mz, float), np.asarray(it, float)
                    order = np.argsort(mz, kind="stable")
                    key, ready = spectrum, (mz[order], it[order], cross_correlation_base(mz, it))
                x, h, base = ready
                b, y = np.asarray(b, float), np.asarray(y, float)
                ions = np.concatenate([b, y])
                out.append((spectrum, seq, decoy, cross_correlation(base, ions), binomial_score(x, h, ions, fragment_tolerance), hyperscore(h, matched(x, b, fragment_tolerance), matched(x, y, fragment_tolerance))))
            yield pd.DataFrame(out, columns=["spectrum", "sequence", "decoy", "xcorr", "binomial", "hyper"])

    scored = rows.select("spectrum", "sequence", "decoy", ion("b"), ion("y"), "mz", "intensity").mapInPandas(run, f"spectrum {kind}, sequence string, decoy boolean, xcorr double, binomial double, hyper double")
    top = F.max("xcorr").over(Window.partitionBy("spectrum"))
    return scored.withColumn("delta_best", F.when(top > 0, (top - F.col("xcorr")) / top))


def charge_states(mz: np.ndarray, charges: range = range(1, 7), width: float = 0.02, level: float = 0.05, rounds: int = 1000, seed: int = 1) -> list[tuple[int, int, float]]:
    """(charge, peaks, p) of the charges whose isotope ladders among sorted ``mz`` are longer than chance allows.

    A ladder is a chain of peaks spaced by one isotope over the charge. Its p is the share of random spectra, with as many
    peaks over the same range, that hold as long a ladder. A charge whose peaks another charge's ladder contains is dropped.
    Random spectra are drawn a part at a time, no more once so many hold as long a ladder that p is above ``level`` whatever the others hold.
    """
    mz = np.sort(np.asarray(mz, float))
    if len(mz) < 2:
        return []

    def steps(x: np.ndarray, z: int) -> np.ndarray:
        hit = matched(x, x - ISOTOPE_GAP / z, width)
        return np.where(hit < np.arange(len(x)), hit, -1)

    def longest(x: np.ndarray, z: int) -> tuple[int, int]:
        """(peaks, last peak) of the longest ladder: all ladders go down one step at a time."""
        hit, at, n = steps(x, z), np.arange(len(x)), 0
        last = at
        while len(at):
            n += 1
            on = hit[at] >= 0
            if not on.any():
                return n, int(last[0])
            at, last = hit[at[on]], last[on]
        return n, 0

    def ladder(x: np.ndarray, z: int) -> list[int]:
        hit, (_, i) = steps(x, z), longest(x, z)
        out = [i]
        while hit[out[-1]] >= 0:
            out.append(int(hit[out[-1]]))
        return out

    # Random spectra stand one after the other, too far apart for a step between them.
    part, apart = max(1, min(rounds // 16 + 1, 200_000 // len(mz))), mz[-1] - mz[0] + 4 * (ISOTOPE_GAP + width)

    def share(z: int, n: int) -> float:
        """p of a ladder of ``n`` peaks, or a lower bound of it that is above ``level``."""
        count = 0
        for a in range(0, rounds, part):
            some = mz[0] + (mz[-1] - mz[0]) * _unit_spectra(seed, a, min(part, rounds - a), len(mz))
            hit = steps((some + apart * np.arange(len(some))[:, None]).ravel(), z)
            first = at = np.arange(len(hit))
            for _ in range(n - 1):
                on = hit[at] >= 0
                first, at = first[on], hit[at[on]]
            count += len(np.unique(first // len(mz)))
            if (1 + count) / (rounds + 1) > level:
                break
        return (1 + count) / (rounds + 1)

    found = []
    for z in charges:
        own = ladder(mz, z)
        p = share(z, len(own)) if len(own) > 1 else 1.0
        if p <= level:
            found.append((z, frozenset(own), p))
    return [(z, len(s), p) for z, s, p in found if not any(s < o for _, o, _ in found)]


@lru_cache(maxsize=32)
def _unit_spectra(seed: int, start: int, count: int, peaks: int) -> np.ndarray:
    """Sorted random spectra between 0 and 1, from number ``start`` of the seed's stream on: the same for all spectra of so many peaks."""
    return np.sort(np.random.Generator(np.random.PCG64(seed).advance(start * peaks)).random((count, peaks)), axis=1)


def once_each(f: Callable, arrays: Iterable) -> Iterator:
    """``f`` of each array, computed once for equal ones that follow each other."""
    last, got = None, None
    for x in arrays:
        x = np.asarray(x, float)
        if last is None or not np.array_equal(x, last):
            last, got = x, f(x)
        yield got


@lru_cache(maxsize=1024)
def _spectrum_of_rest(sequence: str, peaks: int) -> tuple[int, int, np.ndarray]:
    """(nitrogen atoms, transform size, transform of all other elements) of a peptide."""
    atoms = np.sum([ATOMS[r] for r in sequence if r in ATOMS] + [(0, 2, 0, 1, 0)], axis=0)
    # Room for every nitrogen to be heavy and far more than the other elements' neutrons, so that nothing wraps around.
    size = 1 << int(peaks + atoms[2] + 64 + atoms.sum() // 20).bit_length()
    f = np.ones(size // 2 + 1, complex)
    for element, n in zip("CHOS", atoms[[0, 1, 3, 4]], strict=True):
        f *= np.fft.rfft(ISOTOPES[element], size) ** int(n)
    return int(atoms[2]), size, f


def isotope_pattern(sequence: str, heavy_nitrogen: float | None = None, peaks: int = 30) -> np.ndarray:
    """Shares of a peptide's isotopes by added neutrons: element distributions raised to their atoms by Fourier transform.

    ``heavy_nitrogen``: share of N-15 in place of its natural abundance. Unknown residues are left out.
    """
    n, size, rest = _spectrum_of_rest(sequence, peaks)
    share = ISOTOPES["N"] if heavy_nitrogen is None else (1 - heavy_nitrogen, heavy_nitrogen)
    p = np.clip(np.fft.irfft(rest * np.fft.rfft(share, size) ** n, size)[:peaks], 0, None)
    return p / p.sum()


@lru_cache(maxsize=1024)
def _reach(sequence: str) -> int:
    """Number of a peptide's isotopes by added neutrons, at any share of N-15: all its nitrogens may be heavy, of the others as many
    neutrons as have a share above the transform's rounding."""
    n, size, rest = _spectrum_of_rest(sequence, 30)
    return n + 1 + int(np.flatnonzero(np.fft.irfft(rest, size) >= 1e-15).max())


def drawn_pattern(sequence: str, heavy_nitrogen: float, ions: int, seed: int, peaks: int = 30) -> np.ndarray:
    """Shares of the added neutrons of ``ions`` molecules, drawn from the peptide's whole pattern: a measurement with counting noise.

    Molecules are independent, so their numbers by neutrons are one multinomial draw, of the same law as isotopes drawn atom by atom.
    Every molecule counts: there are ``peaks`` shares, or as many more as the peptide's isotopes need, whatever the share of N-15.
    """
    peaks = max(peaks, _reach(sequence))
    n, size, rest = _spectrum_of_rest(sequence, peaks)
    p = np.clip(np.fft.irfft(rest * np.fft.rfft((1 - heavy_nitrogen, heavy_nitrogen), size) ** n, size), 0, None)
    # The transform's rounding (1e-17) is no isotope.
    p[p < 1e-15] = 0
    counts = np.random.default_rng(seed).multinomial(ions, p / p.sum())[:peaks].astype(float)
    return counts / max(1.0, counts.sum())


def divergence(measured: np.ndarray, model: np.ndarray, floor: float = 1e-9) -> float:
    p, q = np.asarray(measured, float) + floor, np.asarray(model, float) + floor
    p, q = p / p.sum(), q / q.sum()
    return float((p * np.log(p / q)).sum())


def label_efficiency(sequence: str, measured: np.ndarray, low: float = 0.8, high: float = 0.9999, tolerance: float = 1e-5) -> tuple[float, float]:
    """(efficiency, divergence) of the N-15 share whose pattern is nearest to ``measured``, by golden sections."""
    e, kl = label_efficiencies(sequence, np.asarray(measured, float)[None], low, high, tolerance)
    return float(e[0]), float(kl[0])


def label_efficiencies(sequence: str, measured: np.ndarray, low: float = 0.8, high: float = 0.9999, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """``label_efficiency`` of many measurements (rows) of one peptide, all sections at once."""
    n, size, rest = _spectrum_of_rest(sequence, measured.shape[1])
    # The other elements' pattern behind 0, 1, 2 ... heavy nitrogens: a share's pattern weighs these by the binomial law.
    other, width = np.fft.irfft(rest, size), measured.shape[1]
    behind = np.array([np.concatenate([np.zeros(min(k, width)), other[: max(0, width - k)]]) for k in range(n + 1)])
    ways = np.array([math.comb(n, k) for k in range(n + 1)], float)
    heavy = np.arange(n + 1)
    p = measured + 1e-9
    p = p / p.sum(axis=1, keepdims=True)
    own = (p * np.log(p)).sum(axis=1)

    def cost(e: np.ndarray) -> np.ndarray:
        q = np.clip((ways * e[:, None] ** heavy * (1 - e[:, None]) ** (n - heavy)) @ behind, 0, None)
        q = q / q.sum(axis=1, keepdims=True) + 1e-9
        return own - (p * np.log(q / q.sum(axis=1, keepdims=True))).sum(axis=1)

    golden = (math.sqrt(5) - 1) / 2
    low, high = np.full(len(p), low), np.full(len(p), high)
    c, d = high - golden * (high - low), low + golden * (high - low)
    fc, fd = cost(c), cost(d)
    while (high - low > tolerance).any():
        left = fc < fd
        low, high = np.where(left, low, c), np.where(left, d, high)
        new = np.where(left, high - golden * (high - low), low + golden * (high - low))
        f = cost(new)
        c, d, fc, fd = np.where(left, new, d), np.where(left, c, new), np.where(left, f, fd), np.where(left, fc, f)
    best = (low + high) / 2
    return best, cost(best)


def centroids(mz: np.ndarray, intensity: np.ndarray, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(m/z, height) of each profile peak above ``threshold``: a profile is cut at its valleys, m/z weighted by intensity."""
    y = np.asarray(intensity, float)
    if not len(y):
        return np.empty(0), np.empty(0)
    valley = np.flatnonzero((y[1:-1] <= y[:-2]) & (y[1:-1] < y[2:])) + 1
    part = np.searchsorted(valley, np.arange(len(y)), side="right")
    weight = np.bincount(part, y)
    height = np.zeros(len(weight))
    np.maximum.at(height, part, y)
    keep = (height > threshold) & (weight > 0)
    return np.bincount(part, y * np.asarray(mz, float))[keep] / weight[keep], height[keep]


def spectral_library(psms: DataFrame, peaks: DataFrame, tolerance: float, extra: tuple[Column, ...] = ()) -> DataFrame:
    """file, sequence, series, number and the peaks' number, mean, least and greatest share of their spectrum's
    highest peak and its variation, mean m/z and its variation, mean and mean absolute m/z error.

    ``psms``: file, spectrum, sequence; ``peaks``: spectrum, mz, intensity. Fragments meet the peaks of their own
    spectrum within ``tolerance`` Da by buckets of m/z; every match counts.
    """
    top = peaks.groupBy("spectrum").agg(F.max("intensity").alias("top"))
    ions = psms.select("file", "spectrum", "sequence", F.explode(fragments(F.col("sequence"))).alias("f")).select("file", "spectrum", "sequence", "f.series", "f.number", F.col("f.mz").alias("ion_mz"))
    m = F.col("ion_mz")
    hit = range_join(ions, peaks, m - tolerance, m + tolerance, F.col("mz"), max(2 * tolerance, 0.01), on=["spectrum"]).join(top, "spectrum")
    share = F.col("intensity") / F.col("top")
    return hit.groupBy("file", "sequence", "series", "number").agg(F.count("*").alias("matches"), F.avg(share).alias("mean_share"), F.max(share).alias("max_share"), F.avg(F.col("mz") - m).alias("mean_error"),
        F.min(share).alias("min_share"), F.try_divide(F.stddev_samp(share), F.avg(share)).alias("cv_share"), F.avg("mz").alias("mean_mz"), F.try_divide(F.stddev_samp("mz"), F.avg("mz")).alias("cv_mz"), F.avg(F.abs(F.col("mz") - m)).alias("mean_abs_error"), *extra)


def consensus_library(library: DataFrame, min_files: int = 2) -> DataFrame:
    """sequence and its fragments (median share over files), of those found in ``min_files`` files or more."""
    per = library.groupBy("sequence", "series", "number").agg(F.count_distinct("file").alias("files"), F.median("mean_share").alias("share")).where(F.col("files") >= min_files)
    return per.groupBy("sequence").agg(F.sort_array(F.collect_list(F.struct("series", "number", "files", "share"))).alias("fragments"))
