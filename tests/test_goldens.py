"""Published results of the tools on small inputs (tests/data, fixed values): every number of every table."""

import csv
import json
import os

import pytest
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ionloom.plans import psm_statistics, tools
from ionloom.sources import tables

DATA = os.path.join(os.path.dirname(__file__), "data")
TEXT = ["FileName", "ProteinGroup", "StringSequence", "PeptideSequence", "Class"]
WHOLE = ["PepSequenceID", "ModSequenceID", "Charge", "GlobalMod"]
QUANT = ["FileName", "ProteinGroup", "ProteinGroup_QValue", "StringSequence", *WHOLE, "Quant_Light", "Quant_Heavy", "Correlation_Light_Heavy", "AlignmentQValue"]


def schema(names):
    kind = lambda n: StringType() if n in TEXT else IntegerType() if n in WHOLE else DoubleType()
    return StructType([StructField(n, kind(n)) for n in names])


def golden(path):
    with open(path) as f:
        rows = list(csv.DictReader(f, delimiter="\t"))
    value = lambda k, v: v if k in TEXT else float(v) if v not in ("", "NaN") else None
    return [{k: value(k.split(".")[-1], v) for k, v in r.items()} for r in rows]


def same(df, path, keys):
    want = golden(path)
    names = list(want[0])
    assert set(names) <= set(df.columns)
    number = lambda x: x if isinstance(x, str) or x is None else float(x)
    order = lambda r: tuple(str(r[k]) for k in keys)
    got = sorted(({n: number(r[n]) for n in names} for r in df.collect()), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g == {k: v if isinstance(v, str) or v is None else pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in w.items()}


def params(name):
    with open(f"{DATA}/params.json") as f:
        return tables.plain_params(json.load(f)[name])


def checked(levels, name):
    for level, df in levels.items():
        same(df, f"{DATA}/{name}_{level}.tsv", ["PepSequenceID", "StringSequence", "Charge"] if level == "global" else [c for c in ("PepSequenceID", "StringSequence", "ModSequenceID") if c in df.columns] or ["ProteinGroup"])
    pivoted = tools.by_file(levels["protein"], [r.FileName for r in levels["protein"].select("FileName").distinct().collect()])
    same(pivoted, f"{DATA}/{name}_files.tsv", ["ProteinGroup"])


@pytest.mark.parametrize("name", ["normal", "charge_agg", "charge_agg_mod_agg", "transform_filter_sum"])
def test_label_free(spark, name):
    quant = tables.read_table(spark, f"{DATA}/label_free.tsv", schema(QUANT))
    checked(tools.label_free_levels(quant, tools.quantification(params(f"label_free_{name}"), tools.LIGHT)), f"label_free_{name}")


@pytest.mark.parametrize("name", ["normal", "corr_filter_charge_agg", "corr_filter_charge_agg_mod_agg", "transform_filter_sum", "corr_filter"])
def test_labeled(spark, name):
    quant = tables.read_table(spark, f"{DATA}/labeled.tsv", schema(QUANT))
    checked(tools.labeled_levels(quant, tools.quantification(params(f"labeled_{name}"), tools.BOTH)), f"labeled_{name}")


def test_fixed_thresholds(spark):
    cut = params("fixed")["Threshold"][1]
    low = [v for k, v in sorted(cut.items(), reverse=True)]  # Sequest, then Andromeda
    rows = tables.read_table(spark, f"{DATA}/fixed_in.tsv", schema(["SequestScore", "AndroScore", "Label"])).where("Label = 1")
    got = psm_statistics.over_thresholds(rows, *low)
    assert sorted(r.SequestScore for r in got.collect()) == pytest.approx(sorted(r["SequestScore"] for r in golden(f"{DATA}/fixed_out.tsv")))


def test_deduced_peptides(spark):
    prot = tables.read_table(spark, [f"{DATA}/deduced_prot{i}.tsv" for i in (1, 2)], schema(["ProteinGroup", "PeptideSequence", "Class", "TargetScore", "DecoyScore", "QValue"]))
    quant = tables.read_table(spark, [f"{DATA}/deduced_quant{i}.tsv" for i in (1, 2)], schema(["StringSequence"]), file_column="FileName")
    out = tools.add_deduced_peptides(prot, quant).collect()
    for i in (1, 2):
        want = {r["ProteinGroup"]: r for r in golden(f"{DATA}/deduced_out{i}.tsv")}
        got = {r.ProteinGroup: r for r in out if r.FileName == f"deduced_quant{i}"}
        assert got.keys() == want.keys()
        for k, w in want.items():
            g = got[k]
            assert sorted(g.PeptideSequence.split(";")) == sorted(w["PeptideSequence"].split(";"))
            assert (g.Class, g.TargetScore, g.DecoyScore, g.QValue) == (w["Class"], *[pytest.approx(w[c]) for c in ("TargetScore", "DecoyScore", "QValue")])
