"""Steps that must not grow faster than the input, with the same results."""

import hashlib
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

import ionloom.plans.ion_queries  # noqa: F401
from ionloom.functions import columns
from ionloom.operators import fdr, grid, inference, joins, lineage, ordered, quantification, spectra
from ionloom.plans import protein_inference, scoring
from ionloom.plans.driver_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_label_efficiency_is_dealt_to_tasks_and_drawn_at_once(spark):
    assert QUERIES["label_efficiency"](spark, SF).rdd.getNumPartitions() > 1
    seq, share, ions = "SAMPLEK", 0.93, 200_000
    # Atom by atom, as a plain loop over elements.
    rng, atoms = np.random.default_rng(1), np.sum([spectra.ATOMS[r] for r in seq] + [(0, 2, 0, 1, 0)], axis=0)
    neutrons = rng.binomial(int(atoms[2]), share, ions)
    for element, n in zip("CHOS", atoms[[0, 1, 3, 4]], strict=True):
        p = np.array(spectra.ISOTOPES[element])
        neutrons = neutrons + rng.multinomial(int(n), p / p.sum(), ions) @ np.arange(len(p))
    want = np.bincount(neutrons, minlength=30)[:30] / ions
    many = np.array([spectra.drawn_pattern(seq, share, ions, seed=k) for k in range(3)])
    assert np.abs(many - want).max() < 0.006 and np.isclose(many.sum(axis=1), 1).all()
    e, kl = spectra.label_efficiencies(seq, many)
    assert [(a, b) for a, b in zip(e, kl, strict=True)] == [spectra.label_efficiency(seq, m) for m in many] and np.abs(e - share).max() < 0.003


def _tables(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _as_sql(spark, sf, query, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    df = QUERIES[query](spark, sf)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"select {cols} from ({ORACLES[query]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
    return want


def test_isotope_match_counts_equal_predicted_peaks_once(spark, tmp_path):
    # Shares are event_id % 5 + 1: two equal ones, and another one of the same mass; 12.13 is 2 from 10.13 but for rounding.
    rows = [(1, 7, "view", 10.0), (6, 7, "view", 10.0), (2, 7, "view", 10.0), (3, 8, "view", 10.13), (4, 7, "click", 11.0), (5, 7, "click", 9.5), (8, 8, "click", 12.13)]
    sf = _tables(spark, tmp_path, events=(rows, "event_id long, user_id long, event_type string, value double"))
    assert (7, 9.5, 5.0, 5.0) in _as_sql(spark, sf, "isotope_match", "events")


def test_similar_vectors_at_the_threshold_as_sql(spark, tmp_path):
    # One common bin: 30 * 56 / sqrt(1800 * 3200) = 0.7, which doubles put just below.
    rows = [(50, 1, 30.0), (50, 2, 30.0), (51, 1, 56.0), (51, 3, 8.0), (52, 1, 30.0), (52, 2, 29.0)]
    sf = _tables(spark, tmp_path, lineitem=(rows, "l_orderkey long, l_suppkey long, l_quantity double"))
    assert [r[:2] for r in _as_sql(spark, sf, "similar_vectors", "lineitem")] == [(50, 52)]


def _seen(monkeypatch, module, name):
    """Rows of both sides of every call of a join."""
    counts, join = [], getattr(module, name)

    def spy(left, right, *args, **kw):
        counts.append((left.count(), right.count()))
        return join(left, right, *args, **kw)

    monkeypatch.setattr(module, name, spy)
    return counts


def _copies(spark, tmp_path, n):
    part = [(k + 300 * c, 10 + k % 7, 3900.0 + 20 * (k % 11)) for k in range(30) for c in range(n)] + [(1, 11, None)]
    events = [(k + 9700 * c, 195.0 + k % 13) for k in range(200) for c in range(n)] + [(2, None)]
    return _tables(spark, tmp_path, part=(part, "p_partkey long, p_size int, p_retailprice double"), events=(events, "event_id long, value double"))


def test_windows_and_peaks_meet_once_whatever_their_copies(spark, tmp_path, monkeypatch):
    seen, found = _seen(monkeypatch, quantification, "grid_join"), {}
    for n in (1, 6):
        sf = _copies(spark, tmp_path / str(n), n)
        for name in ("isotope_envelope", "mobility_band_join"):
            found[name, n] = len(_as_sql(spark, sf, name, "part", "events"))
    # Copies of ions get rows of their own, from joins of the same sizes.
    assert seen[0] == seen[2] and seen[1] == seen[3]
    assert all(found[name, 6] == 6 * found[name, 1] > 0 for name in ("isotope_envelope", "mobility_band_join"))


def test_ppm_range_join_meets_prices_once(spark, tmp_path, monkeypatch):
    rows = [(k, 900.0 + k % 5) for k in range(40)] + [(1, 903.0), (1, 904.0), (2, 902.0), (50, None)]
    seen, sf = _seen(monkeypatch, joins, "range_join"), _tables(spark, tmp_path, part=(rows, "p_partkey long, p_retailprice double"))
    assert len(_as_sql(spark, sf, "ppm_range_join", "part")) > 500
    assert seen == [(12, 6)]


def test_joins_of_cells_and_buckets_broadcast_no_side(spark):
    a, b = spark.range(10).select(F.col("id").alias("i"), F.col("id").cast("double").alias("x")), spark.range(20).select(F.col("id").cast("double").alias("y"))
    for df in (joins.range_join(a, b, F.col("x") - 1, F.col("x") + 1, F.col("y"), 2.0), grid.grid_join(a, b, [grid.Axis(F.col("x") - 1, F.col("x") + 1, F.col("y"))])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and df.count() == 29


def test_dense_parts_are_covered_in_few_rounds(spark, monkeypatch):
    r = random.Random(5)
    sets = {f"p{i:02d}": set(r.sample(range(150), r.randint(25, 40))) for i in range(30)}
    pairs = spark.createDataFrame([(p, g) for g, s in sets.items() for p in s], "peptide long, protein string")
    want = {x.protein_group: x.peptides for x in inference.infer_groups(pairs).collect()}
    rounds, cut = [], inference.cut
    monkeypatch.setattr(inference, "cut", lambda df: rounds.append(1) or cut(df))
    assert {x.protein_group: x.peptides for x in inference.infer_groups(pairs, 400).collect()} == want
    # One group a round, as the votes of a dense part are, makes three tables of each.
    assert len(want) > 8 and len(rounds) < 3 * len(want)


def test_groups_gather_lists_of_peptides(spark):
    rows = [(f"s{i}", ";".join(sorted({f"p{i % 4}", f"p{i % 3}"})), "C3b") for i in range(24)] + [("s0", "p0", "C3b")]
    found = spark.createDataFrame(rows, "sequence string, protein_group string, class string")
    for usage in ("maximal", "inverse"):
        df = inference.grouped(found, [], usage)
        own = {g: set(g.split(";")) for _, g, _ in rows}
        fits = (lambda a, b: bool(a & b)) if usage == "maximal" else (lambda a, b: a <= b)
        assert {r.protein_group: r.peptides for r in df.collect()} == {g: ";".join(sorted({s for s, h, _ in rows if fits(p, own[h])})) for g, p in own.items()}
        assert "collect_list(__list" in df._jdf.queryExecution().optimizedPlan().toString()


def test_costly_rows_are_dealt_to_all_cores(spark):
    for name in ("protease_rules", "charge_states", "labeled_ions", "label_free_ions", "requantified_ions"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan, name


def test_digest_computes_fragments_once(spark):
    df = spark.createDataFrame([("AKRPGKKMR",), ("",), ("GG",), (None,)], "s string").select(columns.digest(F.col("s"), "trypsin", 1).alias("d"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(s") == 1
    got = [None if r.d is None else [(x.peptide, x.start, x.missed) for x in r.d] for r in df.collect()]
    assert got[0] == [("AK", 0, 0), ("RPGK", 2, 0), ("K", 6, 0), ("MR", 7, 0), ("AKRPGK", 0, 1), ("RPGKK", 2, 1), ("KMR", 6, 1)]
    assert got[1] == [] and got[2] == [("GG", 0, 0)]


def test_peptide_classes_do_not_copy_rows(spark):
    pairs = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p1"), ("c", "p1"), ("c", "p3")], "peptide string, protein string")
    proteins = spark.createDataFrame([("p1", "l1", None), ("p2", "l1", None), ("p3", "l2", None)], "protein string, locus string, sequence string")
    df = inference.peptide_classes(pairs, proteins)
    assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.peptide: r["class"] for r in df.collect()} == {"a": "C2a", "b": "C1b", "c": "C3b"}


def test_window_totals_make_no_pairs(spark):
    rng = random.Random(5)
    spread = [(rng.choice("ab"), rng.choice([rng.uniform(-9, 9), round(rng.uniform(-9, 9), 1), 0.0, 2.0]), rng.randrange(1000)) for _ in range(400)]
    points = [*spread, *[("a", 3.0, k) for k in range(2000)], ("a", None, 1), ("a", float("nan"), 2), ("a", float("inf"), 3), (None, 1.0, 4), ("b", 5.0, None)]
    starts = [rng.choice([rng.uniform(-10, 10), round(rng.uniform(-10, 10), 1)]) for _ in range(200)]
    windows = [("a", 2.9, 3.1)] * 300 + [(rng.choice("abc"), x, x + rng.choice([0.0, 1e-9, 0.1, 0.5, 3.0, 40.0, -1.0])) for x in starts]
    windows += [("a", float("-inf"), float("inf")), ("b", float("-inf"), -4.0), ("a", None, 1.0), ("a", 1.0, float("nan")), (None, 0.0, 2.0), ("b", 5.0, 5.0), ("a", -1e308, 1e308)]
    w = spark.createDataFrame([(i, *x) for i, x in enumerate(windows)], "i long, run string, low double, high double")
    p = spark.createDataFrame([(r, v, k, None if k is None else str(k)) for r, v, k in points], "run string, rt double, k long, name string")
    out = joins.window_totals(w, p, ["run"], "low", "high", "rt", "n", {"first": ("min", "name"), "last": ("max", "rt"), "all": ("sum", "k")})
    want = []
    for i, (run, low, high) in enumerate(windows):
        held = [(v, k) for r, v, k in points if None not in (run, low, high, v) and r == run and abs(v) < float("inf") and low <= v <= high]
        if held:
            ks = [k for _, k in held if k is not None]
            want.append((i, run, low, high, len(held), min(map(str, ks), default=None), max(v for v, _ in held), sum(ks) if ks else None))
    assert sorted(map(tuple, out.collect())) == want


def test_time_windows_pairs_nothing(spark, tmp_path):
    # 600 equal windows and points: a range join would make their pairs by buckets.
    rows = [(k, "purchase" if k % 2 else "error", 35.0 if k % 3 else 30 + k % 100 / 10) for k in range(900)]
    sf = _tables(spark, tmp_path, events=(rows, "event_id long, event_type string, value double"))
    assert len(_as_sql(spark, sf, "time_windows", "events")) > 800
    assert "__bucket" not in QUERIES["time_windows"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_roll_ups_are_dealt_to_more_tasks_as_the_input_grows(spark, monkeypatch):
    for query, keys in (("rollup_protein_quant", "l_orderkey"), ("labeled_ratio_rollup", "l_suppkey")):
        plan = lambda: QUERIES[query](spark, SF)._jdf.queryExecution().optimizedPlan().toString()  # noqa: E731, B023
        monkeypatch.setattr(lineage, "TASK_ROWS", 250_000)
        assert f"RepartitionByExpression [{keys}#" in plan() and "], 4" in plan()
        # The 6,000 lines of the table are 60 tasks' worth.
        monkeypatch.setattr(lineage, "TASK_ROWS", 100)
        assert "], 60" in plan()


def test_boosted_scores_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.createDataFrame([(i, float(i % 17), float(i % 5), int(i % 17 > 8)) for i in range(300)], "id long, a double, b double, y int")
    out = scoring.boosted_scores(rows.mapInPandas(counted, rows.schema), ["a", "b"], "y", "id")
    assert out.count() == 300 and read.value == 300


def test_inference_meets_a_sequence_once_whatever_its_spectra(spark, monkeypatch):
    seen, own = [], protein_inference.classified
    monkeypatch.setattr(protein_inference, "classified", lambda psms, classes: seen.append(psms.count()) or own(psms, classes))
    classes = spark.createDataFrame([("PEP", "p1", "C1a"), ("MPEP", "p2", "C1a"), ("MKA", "p3", "C1b")], "peptide string, protein_group string, class string")
    psms = [("f", s, float(i)) for i in range(5) for s in ("PEP", "KA", "[ox]KA")] + [("g", "PEP", 9.0)]
    out = protein_inference.infer_proteins(spark.createDataFrame(psms, "file string, sequence string, score double"), classes, spark.createDataFrame([("p1", "KA"), ("d", "PEP")], "protein string, peptide string"))
    rows = {(r.file, r.ProteinGroup): (r.PeptideSequence, r.Class, r.TargetScore, r.DecoyScore) for r in out.collect()}
    # A peptide of the sequence's own name goes before that after an M; each sequence counts by its best score over the files.
    assert rows == {("f", "p1"): ("PEP", "C1a", 9.0, 4.0), ("g", "p1"): ("PEP", "C1a", 9.0, 4.0), ("f", "p3"): ("KA;[ox]KA", "C1b", 8.0, 0.0)}
    assert seen == [4]


def test_rare_scores_are_not_copied_to_every_part(spark, monkeypatch):
    seen, own = [], fdr.running
    monkeypatch.setattr(fdr, "running", lambda df, *args: seen.append(df) or own(df, *args))
    knots = spark.createDataFrame([(0.0, 0.0), (100.0, 1.0)], "s double, q_value double")
    rows = spark.createDataFrame([(i, float(i)) for i in range(50)] + [(i, 7.5) for i in range(50, 450)], "i long, s double")
    assert {r.i: round(r.q_value, 9) for r in fdr.q_between(knots, rows, "s").collect()} == {**{i: i / 100 for i in range(50)}, **{i: 0.075 for i in range(50, 450)}}
    parts = {r["__x"]: bin(r["__parts"]).count("1") for r in seen[0].where("__row").collect()}
    assert parts == {**{float(i): 1 for i in range(50)}, 7.5: fdr.SALTS}


def test_ranges_are_sorted_once(spark):
    df = ordered.running(spark.range(20).withColumn("v", F.lit(1)), [], [F.col("id")], {"s": ("sum", "v")})
    # What is left to the plan runs over a row for each range.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert [r.s for r in df.orderBy("id").collect()] == list(range(1, 21))


def test_peptide_classes_shuffle_pairs_twice(spark):
    pairs = spark.createDataFrame([("a", "p1"), ("a", "p1"), ("a", "p2"), ("b", "p1")], "peptide string, protein string")
    proteins = spark.createDataFrame([("p1", "l1", "S"), ("p2", "l2", "S")], "protein string, locus string, sequence string")
    df = inference.peptide_classes(pairs, proteins)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [peptide#") == 1
    assert {r.peptide: (r.protein_group, r["class"]) for r in df.collect()} == {"a": ("p1;p2", "C3a"), "b": ("p1", "C1a")}


def test_drawn_patterns_hold_every_molecule():
    # 58 nitrogens: at these shares no molecule has less than 40 added neutrons.
    seq = "STANDARDANDIEDTINALMNDANTIEARTICRNFLWER"
    for share in (0.9, 0.95, 0.989):
        drawn = spectra.drawn_pattern(seq, share, 20_000, seed=3)
        assert np.isclose(drawn.sum(), 1) and not drawn[:40].any()
        assert abs(spectra.label_efficiency(seq, drawn)[0] - share) < 0.001


def test_charge_states_draw_until_p_is_decided(monkeypatch):
    def plain(mz, charges, rounds, level=0.05, width=0.02):
        """All random spectra at once, drawn from one stream."""
        def longest(x, z):
            hit = spectra.matched(x, x - spectra.ISOTOPE_GAP / z, width)
            n = np.ones(len(x), int)
            for i in range(len(x)):
                if 0 <= hit[i] < i:
                    n[i] = n[hit[i]] + 1
            return n.max()

        drawn = np.sort(np.random.default_rng(1).uniform(mz[0], mz[-1], (rounds, len(mz))), axis=1)
        own = {z: longest(mz, z) for z in charges}
        p = {z: (1 + sum(longest(x, z) >= own[z] for x in drawn)) / (rounds + 1) for z in charges if own[z] > 1}
        return {z: (own[z], q) for z, q in p.items() if q <= level}

    seen, own = [], spectra.matched
    monkeypatch.setattr(spectra, "matched", lambda mz, ions, t: seen.append(len(ions)) or own(mz, ions, t))
    # A ladder of three with a gap of its own, too far apart for ladders of other charges; and peaks of chance.
    chance = np.sort(np.random.default_rng(7).uniform(0, 60, 40))
    ladder = np.sort(np.concatenate([np.arange(7) * spectra.ISOTOPE_GAP / 2 + 20, np.random.default_rng(2).uniform(0, 100, 20)]))
    for mz, found in ((chance, False), (ladder, True)):
        want = plain(mz, (1, 2, 3), 400)
        seen.clear()
        got = {z: (n, p) for z, n, p in spectra.charge_states(mz, (1, 2, 3), rounds=400)}
        assert got.items() <= want.items() and bool(got) == found
        # Two calls for the spectrum's own ladder of each charge; of random spectra less than half where all are chance.
        assert found or sum(seen) < 3 * 400 * len(mz) / 2


def test_equal_spectra_are_computed_once():
    seen = []
    assert list(spectra.once_each(lambda x: seen.append(len(x)) or x.sum(), [[1.0, 2.0], [1.0, 2.0], [], [], [3.0], [1.0, 2.0]])) == [3, 3, 0, 0, 3, 3]
    assert seen == [2, 0, 1, 2]


def test_lists_of_peptides_go_once_to_a_task(spark, monkeypatch):
    rows = [(f"s{i}", ";".join(sorted({f"p{i % 4}", f"p{i % 3}", f"q{i % 7}"}))) for i in range(60)] + [("s0", "p0"), ("é", "p0"), ("s0", "p0;q1")]
    found = spark.createDataFrame(rows, "sequence string, protein_group string")
    want = {r.protein_group: (len(r.peptides.split(";")), hashlib.md5(r.peptides.encode()).hexdigest()) for r in inference.grouped(found.withColumn("class", F.lit("")), [], "maximal").collect()}
    monkeypatch.setattr(inference, "TASK_GROUPS", 5)
    assert {r.protein_group: (r.peptides, r.listed) for r in inference.listed(found).collect()} == want
    # The joined lists of the usage inverse are the only ones left.
    assert QUERIES["strict_protein_groups"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("collect_list(__list") == 1


def test_scored_groups_are_not_opened_again(spark, tmp_path):
    rows = [(k % 9, (k * 7) % 5, k % 3, float(k % 11)) for k in range(60)] + [(None, 1, 1, 5.0), (3, None, 1, 40.0), (20, 4, 1, -3.0), (21, 9, 2, 2.0)]
    sf = _tables(spark, tmp_path, lineitem=(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"))
    assert len(_as_sql(spark, sf, "scored_protein_groups", "lineitem")) == 3
    assert "split(" not in QUERIES["scored_protein_groups"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
