"""Running results, quantiles, the peptide database, run files, inference and ion models against values known otherwise."""

import base64
import json
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ionloom.operators import fdr, filters, frames, inference, quantification, signal, spectra
from ionloom.operators.ordered import running
from ionloom.operators.quantiles import exact_quantiles
from ionloom.plans import alignment, psm_statistics, tools
from ionloom.sources import mztab, peptide_db, runs, tables
from ionloom.streaming import arrivals


def test_running_results_cross_ranges(spark):
    """One hot key with most rows is cut into ranges; results are those of one pass."""
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.8 else r.choice(["a", "b", None]), i, r.choice([None, r.randint(0, 50)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, v long").repartition(7)
    got = {x.t: x for x in running(df, ["k"], [F.col("t").desc()], {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "last": ("last", "v")}).collect()}
    seen = {}
    for k, t, v in sorted(rows, key=lambda x: -x[1]):
        s = seen.setdefault(k, [None] * 4)
        if v is not None:
            seen[k] = s = [(s[0] or 0) + v, v if s[1] is None else min(s[1], v), v if s[2] is None else max(s[2], v), v]
        assert [got[t].s, got[t].lo, got[t].hi, got[t]["last"]] == s, t
    every = running(df.where("v is not null"), [], [F.col("t")], {"s": ("sum", "v")})
    assert every.agg(F.max("s")).first()[0] == sum(v for _, _, v in rows if v is not None)
    assert running(df.limit(0), ["k"], [F.col("t")], {"s": ("sum", "v")}).count() == 0


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(2)
    data = {"hot": r.normal(0, 1, 400).round(1), "b": r.normal(5, 2, 7), "c": np.array([3.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("empty", None)]
    got = {x.k: (x.a, x.m, x.z) for x in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.25, "m": 0.5, "z": 0.75}).collect()}
    assert got == {k: pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 0.75]))) for k, v in data.items()}


def test_group_filters_do_not_window_groups(spark):
    from ionloom.operators.aggregate import Channel, GroupFilter, filtered

    df = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("a", 500.0), (None, 1.0), (None, 2.0)], "k string, v double")
    kept = filtered(df, Channel("v", group_filters=(GroupFilter("tukey", 1.5), GroupFilter("stdev", 3.0))), ["k"], "o").where("o is not null")
    assert sorted(x.o for x in kept.collect()) == sorted([*map(float, range(20)), 1.0, 2.0])


MZML = """<?xml version="1.0"?><mzML><run id="r"><spectrumList count="2">
<spectrum index="0" id="scan=1" defaultArrayLength="3"><cvParam accession="MS:1000511" name="ms level" value="1"/><scanList><scan><cvParam accession="MS:1000016" value="90" unitAccession="UO:0000010"/></scan></scanList>
<binaryDataArrayList><binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="MS:1000514"/><binary>{mz}</binary></binaryDataArray><binaryDataArray><cvParam accession="MS:1000521"/><cvParam accession="MS:1000574"/><cvParam accession="MS:1000515"/><binary>{it}</binary></binaryDataArray></binaryDataArrayList></spectrum>
<spectrum index="1" id="scan=2" defaultArrayLength="0"><cvParam accession="MS:1000511" value="2"/><scanList><scan><cvParam accession="MS:1000016" value="1.6" unitAccession="UO:0000031"/></scan></scanList><precursorList><selectedIon><cvParam accession="MS:1000744" value="500.25"/></selectedIon></precursorList>
<binaryDataArrayList><binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="MS:1000514"/><binary></binary></binaryDataArray></binaryDataArrayList></spectrum></spectrumList></run></mzML>"""


def test_mzml_and_files(spark, tmp_path):
    mz, it = np.array([100.5, 200.25, 300.125]), np.array([1.0, 2.0, 4.0], "<f4")
    text = MZML.format(mz=base64.b64encode(mz.astype("<f8").tobytes()).decode(), it=base64.b64encode(zlib.compress(it.tobytes())).decode())
    for name in ("one.mzML", "two.MZML"):
        (tmp_path / name).write_text(text)
    (tmp_path / "one.quant").write_text("x")
    df = runs.read_spectra(spark, str(tmp_path / "one.mzML"))
    one, two = sorted(df.collect(), key=lambda r: r.id)
    assert (one.id, one.ms_level, one.rt, one.precursor_mz) == ("scan=1", 1, 1.5, None) and (two.ms_level, two.rt, two.precursor_mz, two.peaks) == (2, 1.6, 500.25, [])
    assert [(p.mz, p.intensity) for p in one.peaks] == [(100.5, 1.0), (200.25, 2.0), (300.125, 4.0)]
    with pytest.raises(ValueError, match="wiff"):
        runs.read_spectra(spark, "a.wiff")
    found = runs.find_files(spark, [str(tmp_path), str(tmp_path / "one.quant"), str(tmp_path / "none")], "mzml")
    assert [os.path.basename(f) for f in found] == ["one.mzML", "two.MZML", "one.quant"]
    pairs, alone = runs.pair_files(found[:2], found[2:])
    assert [(runs.stem(a), runs.stem(b)) for a, b in pairs] == [("one", "one")] and [runs.stem(a) for a in alone] == ["two"]
    out = str(tmp_path / "by_level")
    tables.write_spectra(df, out)
    assert spark.read.parquet(out).count() == 1  # the one with peaks
    binned = str(tmp_path / "bins")
    runs.write_binned(df.withColumn("im", F.col("rt")), "im", 1.0, binned)
    assert spark.read.parquet(binned).where("bin = 1").count() == 2
    rows = str(tmp_path / "rows")
    for _ in range(2):
        runs.write_rows(df.select("id"), rows, append=True)
    assert spark.read.option("header", True).option("sep", "\t").csv(rows).count() == 4
    runs.write_rows(df.select("id"), rows)
    assert spark.read.option("header", True).csv(rows).count() == 2
    assert runs.empty_table(spark, df.schema).columns == df.columns


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1 first\nMKA\nRPC*\n>P2\nAAA\n")
    assert sorted(map(tuple, tables.read_fasta(spark, str(tmp_path / "a.fasta")).collect())) == [("P2", "AAA"), ("sp|P1 first", "MKARPC")]
    (tmp_path / "a.gff3").write_text("##gff-version 3\nchr1\tsrc\tmRNA\t5\t90\t.\t+\t.\tID=t1;Parent=g1\n")
    r = tables.read_gff3(spark, str(tmp_path / "a.gff3")).first()
    assert (r.feature, r.start, r.end, r.score, r.attributes) == ("mRNA", 5, 90, None, {"ID": "t1", "Parent": "g1"})
    df = spark.createDataFrame([(1, [1.5, None])], "i int, a array<double>")
    tables.write_json(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"i": 1, "a": [1.5, None]}
    times = spark.createDataFrame([(60.0, "second"), (1.0, "minute"), (1.0, "hour")], "t double, u string")
    assert [x.m for x in times.select(tables.to_minutes(F.col("t"), F.col("u")).alias("m")).collect()] == [1.0, 1.0, 60.0]


def test_frames_logs_and_pages(spark, tmp_path):
    from ionloom.sources import report

    (tmp_path / "t.tab").write_text("k\tx\tn\ts\nA\t1.5\t3\tNaN\nB\tNaN\t\tq\n")
    df = tables.read_frame(spark, str(tmp_path / "t.tab"), {"n": "string"})
    assert dict(df.dtypes) == {"k": "string", "x": "double", "n": "string", "s": "string"}
    assert sorted(map(tuple, df.collect())) == [("A", 1.5, "3", None), ("B", None, None, "q")]
    assert set(dict(tables.read_frame(spark, str(tmp_path / "t.tab"), infer=False).dtypes).values()) == {"string"}
    log = report.tool_logger("test", str(tmp_path / "a.log"))
    log.debug("kept %d", 3)
    assert "kept 3" in (tmp_path / "a.log").read_text()
    bins = spark.createDataFrame([(1.0, 4, 1), (2.0, 2, None)], "centre double, n int, d int")
    page = report.histogram_page(bins, "centre", ["n", "d"], "q < 1")
    assert page.count("<rect") == 4 and "q &lt; 1" in page
    report.write_page(bins, page, str(tmp_path / "page"))
    assert spark.read.text(str(tmp_path / "page")).first()[0] == page
    with pytest.raises(ValueError):
        report.histogram_page(bins, "centre", ["n"], "t", most=1)


def test_peptide_database_round_trip(spark, tmp_path):
    p = peptide_db.SearchParams(max_missed=1, min_length=2, variable=("ox",), max_variable=1, labels=(0, 1))
    db = peptide_db.build(spark.createDataFrame([("A", "MKAMRPCK"), ("B", "AMRPCK")], "Accession string, Sequence string"), p)
    path = str(tmp_path / "db")
    peptide_db.write(db, path, p)
    assert peptide_db.search_params(spark, path) == p
    back = peptide_db.read(spark, path, keep=True)
    assert sorted(map(tuple, peptide_db.protein_scan(back).collect())) == [("A", "MKAMRPCK"), ("B", "AMRPCK")]
    mods = {(r.Sequence, r.GlobalMod): r.RealMass for r in back["modsequence"].collect()}
    assert {s for s, _ in mods} == {"MK", "M[ox]K", "AMRPCK", "AM[ox]RPCK", "MKAMRPCK", "M[ox]KAMRPCK", "MKAM[ox]RPCK"}
    assert mods["M[ox]K", 0] - mods["MK", 0] == pytest.approx(15.994915) and mods["MK", 1] - mods["MK", 0] == pytest.approx(3 * 0.997035)
    ids = {r.Sequence: r.ID for r in back["pepsequence"].collect()}
    keys = spark.createDataFrame([(ids["AMRPCK"],), (5,)], "k long")
    assert {r.k: r.found_Sequence for r in peptide_db.peptide_by_id(keys, back, "k").collect()} == {ids["AMRPCK"]: "AMRPCK", 5: ""}
    assert {r.k: r.found_Accession for r in peptide_db.protein_by_id(keys, back, "k").collect()} == {ids["AMRPCK"]: "", 5: ""}
    mod = back["modsequence"].where("Sequence = 'MK' and GlobalMod = 1").first()
    got = peptide_db.modified_by_id(spark.createDataFrame([(mod.ID,), (7,)], "m long"), back, "m").orderBy(F.col("m") == 7).collect()
    assert (got[0].found_Sequence, got[0].found_GlobalMod) == ("MK", 1) and (got[1].found_Sequence, got[1].found_PepSequenceID) == ("", -1)
    look = peptide_db.proteins_of_peptides(keys, back, "k").collect()
    assert {(r.Accession, r.CleavageStart, r.CleavageEnd) for r in look} == {("A", 2, 7), ("B", 0, 5)}


def test_frames_refuse_what_must_not_be(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, "y")], "k int, v string")
    assert frames.disjoint_union(a, b, ["k"]).count() == 2
    with pytest.raises(Exception, match="key on both sides: 1"):
        frames.disjoint_union(a, a, ["k"]).collect()
    with pytest.raises(Exception, match="no row for 1"):
        frames.lookup_or_fail(a, b.withColumnRenamed("v", "w"), ["k"], ["w"]).collect()
    with pytest.raises(Exception, match="several rows of PSM 1"):
        mztab.psm_section(a.union(a), "k").collect()
    with pytest.raises(ValueError):
        filters.time_difference_filter(a, "Light", 0)
    rows, seen = frames.counted(a, "n")
    assert rows.count() == 1 and seen.get["rows"] == 1


def test_studies_without_runs_are_null(spark):
    rows = spark.createDataFrame([("P", "a", 1.0), ("P", "b", 3.0)], "p string, run string, q double")
    got = mztab.study_averages(rows, ["p"], spark.createDataFrame([(1, "a"), (1, "b")], "study int, run string"), ["q"]).first()
    assert (got.q_mean, got.q_stdev, got.q_sem) == (2.0, pytest.approx(math.sqrt(2)), 1.0)


def test_inference_equals_the_stepwise_cover(spark):
    """The parts' and the distributed cover against the cover that takes one best group at a time."""
    r = random.Random(8)
    pairs = sorted({(f"p{r.randint(0, 60):02d}", f"P{r.randint(0, 25):02d}") for _ in range(150)})
    held = {}
    for pep, prot in pairs:
        held.setdefault(prot, set()).add(pep)
    groups = {}
    for prot, peps in sorted(held.items()):
        groups.setdefault(frozenset(peps), []).append(prot)
    left, want = {";".join(sorted(v)): set(k) for k, v in groups.items()}, set()
    while any(left.values()):
        best = min(left, key=lambda g: (-len(left[g]), g))
        want.add((best, len(left[best])))
        gone = set(left[best])
        left = {g: p - gone for g, p in left.items()}
    df = spark.createDataFrame(pairs, "peptide string, protein string")
    assert {tuple(x) for x in inference.infer_groups(df).collect()} == want
    assert {tuple(x) for x in inference.infer_groups(df, most=3).collect()} == want


def test_connected_parts_of_a_chain(spark):
    chain = [(f"p{i}", f"{i + d:04d}") for i in range(60) for d in (0, 1)] + [("q", "9001"), ("q", "9000")]
    got = {(r.protein, r.part) for r in inference.connected(spark.createDataFrame(chain, "peptide string, protein string")).collect()}
    assert got == {(f"{i:04d}", "0000") for i in range(61)} | {("9000", "9000"), ("9001", "9000")}


def test_evidence_usage(spark):
    pairs = spark.createDataFrame([("a", "P"), ("b", "P"), ("b", "Q"), ("c", "R")], "peptide string, protein string")
    proteins = spark.createDataFrame([("P", "1", "S"), ("Q", "2", "S"), ("R", "3", "T"), ("R2", "3", "U")], "protein string, locus string, sequence string")
    classes = inference.peptide_classes(pairs, proteins)
    assert {(r.peptide, r["class"]) for r in classes.collect()} == {("a", "C1a"), ("b", "C3a"), ("c", "C1b")}
    own = pairs.select("peptide", F.col("peptide").alias("sequence"))
    assert {(r.protein_group, r.peptides) for r in inference.evidence_groups(classes, own).collect()} == {("P", "a"), ("P;Q", "b"), ("R", "c")}
    assert {(r.protein_group, r.peptides) for r in inference.evidence_groups(classes, own, "maximal").collect()} == {("P", "a;b"), ("P;Q", "a;b"), ("R", "c")}


def test_peak_fits():
    x = np.linspace(0, 20, 81)
    gauss = 50 * np.exp(-((x - 9) ** 2) / (2 * 1.5**2))
    fit = quantification.fit_peak(x, gauss)
    assert (fit["quant"], fit["center"], fit["tau"]) == (pytest.approx(50 * 1.5 * math.sqrt(2 * math.pi), rel=1e-3), pytest.approx(9, abs=0.1), 0.0)
    tailed = quantification.modified_gaussian(x, 50, 7, 1.0, 2.0)
    fit = quantification.fit_peak(x, tailed)
    assert fit["tau"] == pytest.approx(2.0, rel=0.1) and fit["quant"] == pytest.approx(np.trapezoid(tailed, x), rel=0.02)
    found = quantification.quantify(x, gauss + 30 * np.exp(-((x - 15) ** 2) / 2), 8.0, baseline=False)
    assert found["center"] == pytest.approx(9, abs=0.2) and found["difference"] == pytest.approx(8 - found["center"])
    assert quantification.quantify(x, np.zeros(81), 3.0) is None and quantification.quantify(x[:3], gauss[:3], 1.0) is None


def test_labeled_ions(spark):
    x = [float(i) for i in range(40)]
    peak = lambda a: [a * math.exp(-((t - 20) ** 2) / 18) for t in x]
    df = spark.createDataFrame([("i", 0, 19.0, x, peak(10.0), peak(5.0)), ("j", 1, 19.0, x, peak(10.0), peak(5.0)), ("none", 0, 1.0, x, [0.0] * 40, [0.0] * 40)], "ion string, global_mod int, at double, rt array<double>, light array<double>, heavy array<double>")
    got = {r.ion: r for r in quantification.quantify_ions(df, baseline=False).collect()}
    assert set(got) == {"i", "j"}
    for r in got.values():
        assert r.quant_light / r.quant_heavy == pytest.approx(2, rel=1e-3) and r.correlation == pytest.approx(1)


def test_warps():
    r = np.random.default_rng(1)
    a, b = r.normal(0, 1, 30), r.normal(0, 1, 25)
    path, cost = quantification.warp_path(a, b)
    assert cost == pytest.approx(signal.dtw_distance(a, b)) and path[0] == (0, 0) and path[-1] == (29, 24)
    assert math.sqrt(sum((a[i] - b[j]) ** 2 for i, j in path)) == pytest.approx(cost)
    x = np.arange(40.0)
    bump = lambda m: np.exp(-((x - m) ** 2) / 8)
    time, before, after = quantification.refined_time(x, bump(15), x, bump(20), 15.0)
    assert time == pytest.approx(20, abs=1) and after < 2


def test_range_join_of_open_and_unknown_bounds(spark):
    from ionloom.operators.joins import range_join

    inf, nan = float("inf"), float("nan")
    left = [(0, 1.0, 2.0), (1, -inf, 1.5), (2, 3.0, inf), (3, nan, 2.0), (4, None, 2.0), (5, 5.0, 4.0), (6, -inf, inf)]
    right = [(10, 0.5), (11, 1.5), (12, 3.0), (13, nan), (14, None), (15, 90.0)]
    a, b = spark.createDataFrame(left, "i int, a double, z double"), spark.createDataFrame(right, "j int, v double")
    want = {(i, j) for i, x, y in left for j, v in right if None not in (x, y, v) and not any(math.isnan(c) for c in (x, y, v)) and x <= v <= y}
    for log in (False, True):
        got = range_join(a, b, F.col("a"), F.col("z"), F.col("v"), 0.5, log=log)
        assert {(r.i, r.j) for r in got.collect()} == want
    assert range_join(a, b.limit(0), F.col("a"), F.col("z"), F.col("v"), 0.5).count() == 0


def test_banded_warp_equals_the_recurrence():
    r = np.random.default_rng(5)
    for n, m, w in ((12, 9, None), (9, 12, 4), (15, 15, 2), (1, 4, None)):
        a, b = r.normal(0, 1, n), r.normal(0, 1, m)
        band = max(w if w is not None else max(n, m), abs(n - m))
        c = np.full((n + 1, m + 1), np.inf)
        c[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(max(1, i - band), min(m, i + band) + 1):
                c[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
        assert signal.dtw_distance(a, b, w) == pytest.approx(np.sqrt(c[n, m]))


def test_best_subset_is_the_least_of_all():
    t = np.arange(60.0)
    shapes = np.array([np.exp(-((t - m) ** 2) / 18) for m in (10, 14, 22, 30, 41)]).T
    y = shapes[:, [0, 2, 4]] @ np.array([3.0, 5.0, 2.0]) + np.random.default_rng(2).normal(0, 0.01, 60)
    used, heights = signal.best_subset(shapes, y)
    assert used == [0, 2, 4] and heights == pytest.approx([3, 5, 2], abs=0.1)
    many = np.array([np.exp(-((t - m) ** 2) / 4) for m in range(0, 60, 4)]).T
    assert sorted(signal.best_subset(many, many[:, 3] * 2 + many[:, 9])[0]) == [3, 9]


def test_label_efficiency_of_drawn_patterns():
    got = [spectra.label_efficiency("SAMPLEPEPTIDEK", spectra.drawn_pattern("SAMPLEPEPTIDEK", e, 50_000, 3))[0] for e in (0.9, 0.95, 0.99)]
    assert got == pytest.approx([0.9, 0.95, 0.99], abs=0.004)


def test_pep_models(spark):
    bins = spark.createDataFrame([(float(i), 1 / (1 + 10 ** (0.5 * i - 2)), 10) for i in range(10)] + [(11.0, 0.0, 5)], "mean_score double, pep double, n long")
    fit = fdr.logit_pep(bins, "mean_score", "pep", [1.0, 3.0]).first()
    assert (fit.width, fit.slope, fit.intercept) == (1.0, pytest.approx(-0.5), pytest.approx(2.0))
    falls = [r.fitted for r in fdr.isotonic_pep(bins.withColumn("pep", F.when(F.col("mean_score") == 4, 0.9).otherwise(F.col("pep"))), "mean_score", "pep", "n").orderBy("mean_score").collect()]
    assert falls == sorted(falls, reverse=True)
    r = random.Random(4)
    rows = [(x, int(r.random() < 1 / (1 + math.exp(-(2 * x - 1))))) for x in (r.uniform(-2, 3) for _ in range(3000))]
    a, b = fdr.logistic_curve(spark.createDataFrame(rows, "s double, y int"), "s", F.col("y"))
    assert a == pytest.approx(-1, abs=0.25) and b == pytest.approx(2, abs=0.25)
    assert fdr.q_values(bins, "mean_score", F.col("n") == 5, None).where("q_value is not null").count() == 0


def test_alignment_transfers_from_the_best_source(spark):
    r = random.Random(6)
    rows = [(run, f"S{i:03d}", 0, 2, i * 0.5 + shift + r.gauss(0, noise), 100.0 + i) for run, shift, noise in (("t", 0.0, 0.01), ("near", 3.0, 0.01), ("far", 7.0, 3.0)) for i in range(60) if not (run == "t" and i % 10 == 4)]
    moved, held = alignment.align(spark.createDataFrame(rows, "run string, sequence string, global_mod int, charge int, rt double, intensity double"), lams=(1, 10, 100))
    got = {x.sequence: x for x in moved.where("target = 't'").collect()}
    assert set(got) == {f"S{i:03d}" for i in range(4, 60, 10)} and {x.source for x in got.values()} == {"near"}
    assert all(got[f"S{i:03d}"].yhat == pytest.approx(i * 0.5, abs=0.2) for i in range(4, 60, 10))
    assert held.where("source = 'near' and target = 't'").count() > 5


def test_table_sort_counts_peptides_once(spark):
    prot = spark.createDataFrame([("e", "P;Q", "AA;CC"), ("e", "R", "DD")], "Experiment string, ProteinGroup string, PeptideSequence string")
    quant = spark.createDataFrame([("e", "AA", 1.0, 9.0), ("e", "AA", 3.0, 7.0), ("e", "CC", 10.0, None), ("e", "DD", None, 1.0)], "Experiment string, StringSequence string, Quant_Light double, Other double")
    got = {r.Proteingroup: r for r in tools.table_sort(prot, quant, ("Quant_Light", "Other"), exceptions=("Other",)).collect()}
    assert {k: (r.DistinctPeptideCount, r.Quant_Light, r.Other) for k, r in got.items()} == {"P": (2, 6.0, 8.0), "Q": (2, 6.0, 8.0), "R": (0, None, 1.0)}
    wide = tools.horizontal(tools.table_sort(prot, quant), ["e"])
    assert set(wide.columns) == {"Proteingroup", "e.DistinctPeptideCount", "e.Quant_Light"}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("ts\tk\tv\n2020-01-01 00:00:10\ta\t1\n2020-01-01 00:00:20\ta\t2\n2020-01-01 00:02:00\tb\t5\n")
    schema = StructType.fromDDL("ts timestamp, k string, v double")
    counts = arrivals.windowed_counts(arrivals.arriving(spark, str(tmp_path / "in"), schema), "ts", ["k"], "v", "1 minute", "0 seconds")
    q = counts.writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r.k, r.n, r.total) for r in spark.table("arrived").collect()) == [("a", 2, 3.0), ("b", 1, 5.0)]


def test_mass_errors(spark):
    rows = [("long", i / 20, 0.001 * math.sin(i / 80)) for i in range(800)] + [("short", float(i), 0.5 if i == 2 else 0.1) for i in range(5)]
    got = quantification.mass_error_model(spark.createDataFrame(rows, "run string, rt double, error double"), "run", "rt").collect()
    assert {round(r.correction, 6) for r in got if r.run == "short"} == {0.1}
    assert all(r.correction == pytest.approx(0.001 * math.sin(r.rt * 20 / 80), abs=3e-4) for r in got if r.run == "long" and 1 < r.rt < 39)


def test_alignment_labels_follow_the_channel_and_both_cutoffs(spark):
    cols = "ion int, GlobalMod int, QuantMz_Light double, QuantMz_Heavy double, Quant_Light double, Quant_Heavy double"
    aligned = spark.createDataFrame([(1, 0, 500.0, 9.0, 100.0, 9.0), (2, 1, 9.0, 500.0, 9.0, 100.0), (3, 0, 506.0, 9.0, 100.0, 9.0), (4, 0, 500.0, 9.0, 111.0, 9.0), (5, 0, 500.0, 9.0, 1.0, 9.0), (6, 0, 500.0, 9.0, 1.0, 9.0), (7, 0, None, 9.0, 100.0, 9.0), (8, 0, 500.0, 9.0, 100.0, 9.0)], cols)
    nan = float("nan")
    measured = spark.createDataFrame([(1, 504.9, 1.0, 109.0, 1.0), (2, 1.0, 500.0, 1.0, 95.0), (3, 500.0, 1.0, 100.0, 1.0), (4, 500.0, 1.0, 100.0, 1.0), (5, 500.0, 1.0, None, 1.0), (7, 500.0, 1.0, 100.0, 1.0), (8, 500.0, 1.0, nan, 1.0)], cols.replace("GlobalMod int, ", ""))
    got = {r.ion: r.good for r in alignment.training_labels(aligned, measured, ["ion"]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 7: False, 8: False}  # 5 has no measured quantity, 6 was not measured
