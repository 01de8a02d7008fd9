"""Spectra, wavelets, logistic fits, inference in rounds and mzTab against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions import masses
from ionloom.operators import inference, signal, spectra
from ionloom.operators.inference import cover_in_rounds, infer_groups
from ionloom.sources import mztab


def test_masses_and_fragments(spark):
    df = spark.createDataFrame([("PEPTIDE",), ("GX",), ("",), (None,), ("G",)], "s string")
    got = {r.s: (r.m, r.f) for r in df.select("s", masses.peptide_mass(F.col("s")).alias("m"), masses.fragments(F.col("s")).alias("f")).collect()}
    assert got["PEPTIDE"][0] == pytest.approx(799.35996, abs=1e-4)
    ions = {(i["series"], i["number"]): i["mz"] for i in got["PEPTIDE"][1]}
    assert len(ions) == 12 and ions["b", 2] == pytest.approx(227.1026, abs=1e-3) and ions["y", 1] == pytest.approx(148.0604, abs=1e-3)
    assert got["GX"] == (None, []) and got[""] == (None, []) and got["G"][1] == [] and not got[None][1]


def test_scores_find_the_peptide(spark):
    peptides = ["PEPTIDEK", "PEPTDIEK", "GASPVTCK", "WWWWWWWK"]
    made = spark.createDataFrame([(p,) for p in peptides], "sequence string")
    row = made.where("sequence = 'PEPTIDEK'").select(masses.peptide_mass(F.col("sequence")).alias("m"), masses.fragments(F.col("sequence")).alias("f")).first()
    mz = [i["mz"] for i in row["f"]]
    x = spark.createDataFrame([(1, row["m"], mz, [10.0] * len(mz)), (2, 5.0, [1.0], [1.0]), (3, row["m"], [], [])], "spectrum long, mass double, mz array<double>, intensity array<double>")
    got = spectra.score_spectra(x, made, 0.5, 0.02).collect()
    assert {r.spectrum for r in got} == {1, 3} and {r.sequence for r in got} == {p for q in peptides[:2] for p in (q, q[::-1])}
    one = {r.sequence: r for r in got if r.spectrum == 1}
    for score in ("xcorr", "binomial", "hyper"):
        assert max(one, key=lambda s: one[s][score]) == "PEPTIDEK"
    assert one["PEPTIDEK"].delta_best == 0 and one["PEPTDIEK"].delta_best > 0
    assert one["PEPTIDEK"].hyper == pytest.approx(math.log10(140 * math.factorial(7) ** 2))


def test_cross_correlation_by_hand():
    rng = np.random.default_rng(2)
    base = spectra.cross_correlation_base(rng.uniform(50, 900, 60), rng.uniform(1, 100, 60), size=1000)
    y = spectra.cross_correlation_base(np.array([500 * 1.0005 + 0.1]), np.array([4.0]), size=1000)
    assert y[500] == 50 and y[425] == pytest.approx(-50 / 150) and y[575] == pytest.approx(-50 / 150) and y[424] == y[576] == 0
    assert np.isfinite(base).all()


def test_charge_states():
    ladder = [500 + i * spectra.ISOTOPE_GAP / 2 for i in range(6)]
    noise = np.random.default_rng(4).uniform(495, 505, 6)
    assert [(z, n) for z, n, _ in spectra.charge_states(np.array([*ladder, *noise]), rounds=300)] == [(2, 6)]
    assert spectra.charge_states(np.array([])) == [] and spectra.charge_states(np.array([1.0])) == []


def test_charge_query_takes_the_references_random_spectra(spark, monkeypatch):
    from ionloom.plans import driver_queries

    ladder = [500 + i * spectra.ISOTOPE_GAP / 2 for i in range(6)]
    one = spark.createDataFrame([(1, [*ladder, 495.3, 504.1])], "spectrum long, mz array<double>")
    monkeypatch.setattr(driver_queries, "_spectra", lambda spark, sf: one)
    row = driver_queries.charge_states(spark, "").first()
    assert row.charges == [2] and row.p == [p for _, _, p in spectra.charge_states(np.array(one.first().mz), range(1, 5), rounds=10_000)] and row.p[0] < 1 / 201


def test_isotopes_and_efficiency():
    p = spectra.isotope_pattern("G")
    atoms = {"C": 2, "H": 5, "N": 1, "O": 2}
    assert p[0] == pytest.approx(math.prod(spectra.ISOTOPES[e][0] ** n for e, n in atoms.items()), rel=1e-3)
    assert p.sum() == pytest.approx(1)
    e, kl = spectra.label_efficiency("PEPTIDEK", spectra.isotope_pattern("PEPTIDEK", 0.953))
    assert e == pytest.approx(0.953, abs=1e-3) and kl < 1e-6


def test_centroids():
    mz = np.arange(10.0)
    m, h = spectra.centroids(mz, np.array([0, 1, 4, 1, 0, 0, 2, 6, 2, 0.0]), 1)
    assert h.tolist() == [4, 6] and m.tolist() == [2, 7]
    assert len(spectra.centroids(np.array([]), np.array([]))[0]) == 0


def test_five_diagonals():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 9):
        a, b, c = rng.uniform(9, 10, n), rng.uniform(-1, 1, n - 1), rng.uniform(-1, 1, max(0, n - 2))
        m = np.diag(a) + np.diag(b, 1) + np.diag(b, -1) + (np.diag(c, 2) + np.diag(c, -2) if n > 2 else 0)
        r = rng.normal(size=n)
        assert np.allclose(signal.solve_five(a, b, c, r), np.linalg.solve(m, r))


def test_spline_and_baseline_are_least_squares():
    rng = np.random.default_rng(7)
    x, y, lam = np.sort(rng.uniform(0, 10, 12)), rng.normal(size=12), 0.7
    h, n = np.diff(x), 12
    q = np.zeros((n, n - 2))
    for i in range(n - 2):
        q[i : i + 3, i] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
    r = np.diag((h[:-1] + h[1:]) / 3) + np.diag(h[1:-1] / 6, 1) + np.diag(h[1:-1] / 6, -1)
    assert np.allclose(signal.smoothing_spline(x, y, lam, x), np.linalg.solve(np.eye(n) + lam * q @ np.linalg.solve(r, q.T), y))
    d = np.diff(np.eye(n), 2, axis=0)
    assert np.allclose(signal.als_baseline(y, 10.0, 0.01, 1), np.linalg.solve(np.eye(n) + 10 * d.T @ d, y))


def test_wavelet_peaks():
    x = np.arange(120.0)
    y = 10 * np.exp(-((x - 30) ** 2) / 18) + 6 * np.exp(-((x - 80) ** 2) / 32)
    got = signal.wavelet_peaks(x, y)
    assert [round(p) for p, *_ in got] == [30, 80] and [h for _, h, _ in got] == pytest.approx([10, 6], rel=0.1)
    assert signal.wavelet_peaks(x, np.zeros(120)) == [] and signal.wavelet_peaks(x[:2], y[:2]) == []


def test_logistic_fit():
    x = np.linspace(0, 4, 60)
    top, k, mid = signal.logistic_fit(x, 0.4 / (1 + np.exp(5.2 * (x - 2))))
    assert (top, k, mid) == (pytest.approx(0.4, rel=0.02), pytest.approx(5.2, rel=0.05), pytest.approx(2, rel=0.02))


def _greedy(sets):
    left, out = set().union(*sets.values()), {}
    while left:
        name = min(sets, key=lambda g: (-len(sets[g] & left), g))
        out[name] = len(sets[name] & left)
        left -= sets[name]
    return out


def test_inference_in_rounds_equals_the_greedy_cover(spark):
    for seed in range(2):
        r = random.Random(seed)
        sets = {f"p{i:02d}": set(r.sample(range(40), r.randint(1, 7))) for i in range(25)}
        pairs = spark.createDataFrame([(p, g) for g, s in sets.items() for p in s], "peptide long, protein string")
        merged = {";".join(sorted(g)): set(k) for k, g in itertools.groupby(sorted(sets, key=lambda n: (sorted(sets[n]), n)), key=lambda n: tuple(sorted(sets[n])))}
        want = _greedy(merged)
        assert {x.protein_group: x.peptides for x in infer_groups(pairs).collect()} == want
        assert {x.protein_group: x.peptides for x in infer_groups(pairs, 0).collect()} == want
    empty = pairs.limit(0)
    assert infer_groups(empty).count() == 0 and cover_in_rounds(empty.withColumnRenamed("protein", "protein_group")).count() == 0
    assert inference.PART_PAIRS > 0


def test_mztab(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b\tc", float("nan")), (1, None, 1.5)], "accession int, d string, x double")
    lines = mztab.mztab_lines(spark, {"mzTab-version": "1.0.0", "title": None, "ms_run[%i]-location": ["a", "b"]}, {"protein": (rows, ["accession"])})
    mztab.write_mztab(lines, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert text.splitlines() == ["MTD\tmzTab-version\t1.0.0", "MTD\tms_run[1]-location\ta", "MTD\tms_run[2]-location\tb", "", "PRH\taccession\td\tx", "PRT\t1\tnull\t1.5", "PRT\t2\tb c\tnull", ""]
