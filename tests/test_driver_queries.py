"""Every query with an oracle against DuckDB, on the smallest driver tables; the others must give rows."""

import os

import duckdb
import pytest

import ionloom.plans.ion_queries  # noqa: F401
from ionloom.plans.driver_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_dtw_has_no_window(spark):
    from ionloom.operators.signal import dtw_distance

    of = {r.vec_id: list(map(float, r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 31").collect()}
    got = {r.vec_id: r.distance for r in QUERIES["dtw_distance"](spark, SF).where("vec_id < 30").collect()}
    assert got == {i: pytest.approx(dtw_distance(of[i], of[i + 1])) for i in got} and len(got) >= 29
    assert any(dtw_distance(of[i], of[i + 1], 8) > got[i] * 1.01 for i in got)
