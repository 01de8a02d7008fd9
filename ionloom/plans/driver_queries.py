"""Queries of the engine's operators over the driver's tables, each beside its DuckDB equivalent.

Doubles whose sums may be ordered differently are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import masses
from ..operators import aggregate as A
from ..operators import fdr, filters, grid, joins, ordered, signal, spectra
from ..operators.inference import evidence_classes, infer_groups
from ..operators.lineage import dealt, spread
from ..sources import mztab

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its oracle where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros():
    """Microseconds of a time stamp without zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("""
WITH l1 AS (SELECT o_custkey, l_orderkey, l_partkey, avg(log2(l_extendedprice)) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            WHERE log2(l_extendedprice) > 12 GROUP BY ALL),
l2 AS (SELECT o_custkey, l_orderkey, avg(q) AS q FROM l1 GROUP BY ALL)
SELECT o_custkey, count(q) AS n_quant, round(avg(q), 4) AS mean_quant, round(stddev_samp(q) / avg(q), 4) AS cv_quant, round(stddev_samp(q), 4) AS sd_quant,
  round(stddev_samp(q) / sqrt(count(q)), 4) AS sem_quant FROM l2 GROUP BY o_custkey""")
def rollup_protein_quant(spark, sf):
    """AGG-01/08/09/11, FLT-01: ion -> peptide -> protein as line -> order -> customer."""
    line, orders = t(spark, sf, "lineitem"), t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    n = line.count()
    # Both levels of the roll-up have the order among their keys, so they are aggregated where lines and orders meet.
    rows = spread(line.select("l_orderkey", "l_partkey", "l_extendedprice"), n, "l_orderkey").join(spread(orders, n, "l_orderkey"), "l_orderkey")
    ch = {"q": A.Channel("l_extendedprice", "log2", above=12)}
    out = A.roll_up(rows, [["o_custkey", "l_orderkey", "l_partkey"], ["o_custkey", "l_orderkey"]], ch)
    return rounded(out.groupBy("o_custkey").agg(*A.dispersion("q", "quant")), "mean_quant", "cv_quant", "sd_quant", "sem_quant")


@query("""
WITH r AS (SELECT l_suppkey, l_partkey, l_extendedprice AS light, l_extendedprice * (1 - l_discount) AS heavy FROM lineitem),
p AS (SELECT l_suppkey, l_partkey, avg(light) AS light, avg(heavy) AS heavy, avg(light / heavy) AS ratio FROM r GROUP BY ALL)
SELECT l_suppkey, round(avg(light), 1) AS light, round(avg(heavy), 1) AS heavy, round(avg(ratio), 6) AS ratio FROM p GROUP BY l_suppkey""")
def labeled_ratio_rollup(spark, sf):
    """AGG-06/12, JN-04, FN-03: light, heavy and their per-row ratio through two levels."""
    rows = t(spark, sf, "lineitem").select("l_suppkey", "l_partkey", F.col("l_extendedprice").alias("l"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("h"))
    rows = spread(rows.withColumn("r", F.try_divide("l", "h")), rows.count(), "l_suppkey", "l_partkey")
    ch = {n: A.Channel(n[0]) for n in ("light", "heavy", "ratio")}
    out = A.roll_up(rows, [["l_suppkey", "l_partkey"], ["l_suppkey"]], ch)
    return rounded(rounded(out, "light", "heavy", digits=1), "ratio", digits=6)


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS mean_q, median(l_quantity) AS median_q, sum(l_quantity) AS sum_q FROM lineitem GROUP BY ALL")
def agg_mean_median_sum(spark, sf):
    """AGG-02/03."""
    q = "l_quantity"
    return rounded(A.grouped_values(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"mean_q": ("mean", q), "median_q": ("median", q), "sum_q": ("sum", q)}), "mean_q")


@query("""SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n_p, round(avg(l_extendedprice), 3) AS mean_p, round(stddev_samp(l_extendedprice) / avg(l_extendedprice), 6) AS cv_p,
round(stddev_samp(l_extendedprice), 3) AS sd_p, round(stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 4) AS sem_p FROM lineitem GROUP BY ALL""")
def agg_dispersion(spark, sf):
    """AGG-05."""
    out = t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*A.dispersion("l_extendedprice", "p"))
    return rounded(rounded(rounded(out, "mean_p", "sd_p", digits=3), "cv_p", digits=6), "sem_p")


def _kept_by(spark, sf, f):
    rows = A.filtered(t(spark, sf, "events"), A.Channel("value", group_filters=(f,)), ["event_type"], "v")
    return rounded(rows.where("v is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("v").alias("s")), "s", digits=3)


@query("""WITH f AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, round(sum(value), 3) AS s FROM events JOIN f USING (event_type) WHERE value BETWEEN q1 - 1.0 * (q3 - q1) AND q3 + 1.0 * (q3 - q1) GROUP BY 1""")
def group_filter_tukey(spark, sf):
    """WIN-01/02."""
    return _kept_by(spark, sf, A.GroupFilter("tukey", 1.0))


@query("""WITH f AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, round(sum(value), 3) AS s FROM events JOIN f USING (event_type) WHERE value BETWEEN m - 1.5 * sd AND m + 1.5 * sd GROUP BY 1""")
def group_filter_stdev(spark, sf):
    """WIN-03."""
    return _kept_by(spark, sf, A.GroupFilter("stdev", 1.5))


@query("""WITH f AS (SELECT event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST) AS r FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(sum(value), 3) AS s FROM f WHERE r <= 25 GROUP BY 1""")
def group_filter_topx(spark, sf):
    """WIN-04."""
    return _kept_by(spark, sf, A.GroupFilter("topx", 25))


@query("""WITH l AS (SELECT o_orderpriority, log2(o_totalprice) AS v FROM orders WHERE o_totalprice > 0),
f AS (SELECT o_orderpriority, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1)
SELECT o_orderpriority, round(median(pow(2, v)), 2) AS price FROM l JOIN f USING (o_orderpriority) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1""")
def tukey_aggregate(spark, sf):
    """WIN-05, FN-02."""
    return rounded(A.tukey_aggregate(t(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", 1.5, "log2", "median", "price"), "price", digits=2)


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE (p_size IS NULL OR (p_size > 10 AND p_size < 40)) AND (p_retailprice IS NULL OR p_retailprice < 1500)")
def field_bounds_filter(spark, sf):
    """FLT-01/02/03/24."""
    return t(spark, sf, "part").where(C.within(F.col("p_size"), 10, 40) & C.within(F.col("p_retailprice"), high=1500)).select("p_partkey", "p_size", "p_retailprice")


@query("""WITH m AS (SELECT median(l_extendedprice) AS mp, median(l_quantity) AS mq FROM lineitem)
SELECT l_orderkey, l_linenumber FROM lineitem, m WHERE log2((l_extendedprice / mp) / (l_quantity / mq)) > -0.5 AND log2((l_extendedprice / mp) / (l_quantity / mq)) < 0.5""")
def quality_filter_median_norm(spark, sf):
    """FLT-14: medians from counts by value, as constants of the filter."""
    rows = t(spark, sf, "lineitem")
    return filters.median_normalised(rows, "l_extendedprice", "l_quantity", -0.5, 0.5).select("l_orderkey", "l_linenumber")


@query(r"""WITH s AS (SELECT p_partkey, p_name || '[' || split_part(p_type, ' ', 1) || ']' AS sequence FROM part)
SELECT p_partkey, regexp_replace(sequence, '[\p{Ll}\[\]]', '', 'g') AS bare FROM s
WHERE len(list_filter(regexp_extract_all(sequence, '\[(\w*)\]', 1), lambda x: x NOT IN ('STANDARD', 'SMALL', 'PROMO'))) = 0""")
def modification_filter(spark, sf):
    """FLT-05, FN-04."""
    s = t(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit("["), F.split("p_type", " ")[0], F.lit("]")).alias("sequence"))
    return s.where(C.modification_ok(F.col("sequence"), ("STANDARD", "SMALL", "PROMO"))).select("p_partkey", C.bare_sequence(F.col("sequence")).alias("bare"))


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part), d AS (SELECT word, count(*) AS uses FROM w GROUP BY 1 HAVING count(*) > 1)
SELECT p_partkey, word, uses FROM w JOIN d USING (word)""")
def align_join(spark, sf):
    """JN-01/03, RSH-02."""
    w = t(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return joins.align(w, w.groupBy("word").agg(F.count("*").alias("uses")).where("uses > 1"), "word")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def overlap_semi(spark, sf):
    """JN-06, SET-04."""
    return t(spark, sf, "customer").join(t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def difference_anti(spark, sf):
    """JN-07/21, SET-05."""
    done = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("""WITH d AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'M' || n_name END AS k, n_regionkey FROM nation)
SELECT n.n_nationkey, coalesce(a.n_regionkey, b.n_regionkey) AS region FROM nation n LEFT JOIN d a ON a.k = n.n_name LEFT JOIN d b ON b.k = 'M' || n.n_name""")
def fallback_lookup(spark, sf):
    """JN-08."""
    n = t(spark, sf, "nation")
    d = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("M"), "n_name")).alias("k"), "n_regionkey")
    return joins.lookup_with_fallback(n.select("n_nationkey", "n_name"), d, F.col("n_name"), F.concat(F.lit("M"), "n_name"), "k", "n_regionkey", "region").select("n_nationkey", "region")


@query("""WITH c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT p.event_id, c.click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_backward(spark, sf):
    """JN-09."""
    e = t(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["click_id"], ["click_id"]).select("event_id", "click_id")


@query("""WITH x AS (SELECT e.event_id, v.event_id AS i, abs(epoch_us(e.ts) - epoch_us(v.ts)) AS d FROM events e JOIN events v USING (user_id) WHERE e.event_type = 'error' AND v.event_type = 'view'),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, i) AS n FROM x)
SELECT event_id, i AS nearest_view_id, round(d / 1e6, 3) AS distance FROM r WHERE n = 1""")
def nearest_event(spark, sf):
    """JN-10."""
    e = t(spark, sf, "events").withColumn("us", micros())
    views = e.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("view_id"))
    out = joins.nearest(e.where("event_type = 'error'").select("event_id", "user_id", "us"), views, ["user_id"], "us", "event_id", "view_id")
    return out.select("event_id", "nearest_view_id", F.round(F.col("distance") / 1e6, 3).alias("distance"))


@query("""SELECT DISTINCT a.p_partkey, b.p_partkey AS other FROM part a JOIN part b
ON b.p_retailprice BETWEEN a.p_retailprice - a.p_retailprice * 100e-6 AND a.p_retailprice + a.p_retailprice * 100e-6
OR b.p_retailprice BETWEEN a.p_retailprice - 1 - (a.p_retailprice - 1) * 100e-6 AND a.p_retailprice - 1 + (a.p_retailprice - 1) * 100e-6""")
def ppm_range_join(spark, sf):
    """JN-11, FN-11: two probes of each distinct price, then the parts of both prices."""
    p = t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price")).distinct()
    prices = p.select("price").distinct()
    probe = prices.select("price", F.explode(F.array(F.col("price"), F.col("price") - 1)).alias("probe"))
    w = C.ppm(F.col("probe"), 100)
    met = joins.range_join(probe, prices.select(F.col("price").alias("mass")), F.col("probe") - w, F.col("probe") + w, F.col("mass"), 2e-4, log=True).select("price", "mass").distinct()
    # A pair of prices is met once, so pairs of parts can only repeat where a part has several prices.
    p = p.join(p.groupBy("p_partkey").agg((F.count("*") > 1).alias("several")).hint("merge"), "p_partkey")
    one, several = p.where("NOT several").drop("several"), p.where("several").drop("several")

    def pairs(left, right):
        # Few rows make many pairs, so both sides are dealt to all cores whatever their bytes.
        return dealt(left.join(met.hint("merge"), "price"), "mass").join(dealt(right.select(F.col("p_partkey").alias("other"), F.col("price").alias("mass")), "mass").hint("merge"), "mass").select("p_partkey", "other")

    return pairs(one, one).unionByName(pairs(several, p.drop("several")).unionByName(pairs(one, several)).distinct())


@query("""WITH x AS (SELECT a.event_id, b.event_id AS i, b.value, abs(b.value - a.value) AS d FROM events a LEFT JOIN events b
  ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.ts BETWEEN a.ts - INTERVAL 2 DAY AND a.ts + INTERVAL 2 DAY AND abs(b.value - a.value) <= 5 WHERE a.event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, i) AS n FROM x) SELECT event_id, coalesce(i, 0) AS hit, round(coalesce(value, 0), 4) AS intensity FROM r WHERE n = 1""")
def xic_band_join(spark, sf):
    """JN-12: nearest value inside a time and value window, zero if there is none."""
    e = t(spark, sf, "events").withColumn("us", micros())
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("us").alias("u0"), F.col("value").alias("v0"))
    b = e.select("user_id", F.col("us").alias("u1"), F.col("value").alias("v1"), F.col("event_id").alias("i"))
    day = 86_400_000_000
    axes = [grid.Axis(F.col("u0") - 2 * day, F.col("u0") + 2 * day, F.col("u1")), grid.Axis(F.col("v0") - 5.000001, F.col("v0") + 5.000001, F.col("v1"))]
    test = F.col("u1").between(F.col("u0") - 2 * day, F.col("u0") + 2 * day) & F.expr("i <> event_id and abs(v1 - v0) <= 5")
    hit = grid.grid_join(a, b, axes, on=["user_id"], test=test)
    best = hit.groupBy("event_id").agg(F.min(F.struct(F.abs(F.col("v1") - F.col("v0")).alias("d"), "i", "v1")).alias("m"))
    return a.select("event_id").join(best, "event_id", "left").select("event_id", F.coalesce("m.i", F.lit(0)).alias("hit"), F.round(F.coalesce("m.v1", F.lit(0.0)), 4).alias("intensity"))


@query("""WITH x AS (SELECT p_size, p_partkey, s_suppkey, s_acctbal - p_retailprice AS delta FROM part JOIN supplier ON s_acctbal BETWEEN p_retailprice - 2 AND p_retailprice + 2)
SELECT p_size, count(*) AS n, round(avg(abs(delta)), 4) AS mean_abs_delta, round(avg(delta), 4) AS mean_delta, round(min(delta), 4) AS min_delta, round(max(delta), 4) AS max_delta FROM x GROUP BY 1""")
def fragment_theta_join(spark, sf):
    """JN-14, AGG-27/28."""
    p, s = t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), t(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    x = joins.range_join(p, s, F.col("p_retailprice") - 2, F.col("p_retailprice") + 2, F.col("s_acctbal"), 4.0).withColumn("d", F.col("s_acctbal") - F.col("p_retailprice"))
    out = x.groupBy("p_size").agg(F.count("*").alias("n"), F.avg(F.abs("d")).alias("mean_abs_delta"), F.avg("d").alias("mean_delta"), F.min("d").alias("min_delta"), F.max("d").alias("max_delta"))
    return rounded(out, "mean_abs_delta", "mean_delta", "min_delta", "max_delta")


def _scored(spark, sf):
    return t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")), "doc_id")


@query("""WITH s AS (SELECT n_chars::DOUBLE AS score, toxic = 1 AS decoy FROM labels JOIN documents USING (doc_id)),
p AS (SELECT score, count(*) FILTER (decoy) AS decoys, count(*) FILTER (NOT decoy) AS targets FROM s GROUP BY 1),
c AS (SELECT *, sum(decoys) OVER (ORDER BY score DESC) / greatest(sum(targets) OVER (ORDER BY score DESC), 1) AS raw FROM p)
SELECT score, decoys, targets, round(min(raw) OVER (ORDER BY score), 8) AS q_value FROM c""")
def storey_qvalue(spark, sf):
    """WIN-06, AGG-24, UDF-27."""
    return rounded(fdr.storey_q(_scored(spark, sf), "score", F.col("toxic") == 1), "q_value", digits=8)


@query("""WITH s AS (SELECT floor(n_chars / 500.0)::BIGINT AS bin, n_chars::DOUBLE AS score, toxic FROM labels JOIN documents USING (doc_id)),
b AS (SELECT bin, avg(score) AS mean_score, sum(toxic)::BIGINT AS decoys, count(*) AS n FROM s GROUP BY 1),
g AS (SELECT sum(decoys)::DOUBLE / sum(n) AS share FROM b)
SELECT bin, round(mean_score, 4) AS mean_score, decoys, n, round(decoys / n / share, 6) AS pep,
  round(sum(decoys) OVER (ORDER BY bin DESC) / sum(n) OVER (ORDER BY bin DESC) / share, 6) AS q_value FROM b, g""")
def binned_pep_q(spark, sf):
    """WIN-07, FN-29."""
    return rounded(rounded(fdr.binned_pep(_scored(spark, sf), "score", F.col("toxic") == 1, 500.0), "mean_score"), "pep", "q_value", digits=6)


@query("SELECT floor(value / 10)::BIGINT AS bin, count(*) AS n, count(*) FILTER (event_type = 'error') AS decoys, round(median(value), 6) AS median_score, floor(value / 10) * 10 + 5.0 AS centre FROM events GROUP BY floor(value / 10)")
def target_decoy_histogram(spark, sf):
    """AGG-14/15."""
    return rounded(A.histogram(t(spark, sf, "events"), "value", 10.0, F.col("event_type") == "error"), "median_score", digits=6)


@query("SELECT user_id % 10 AS part, round(count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type <> 'error'), 0), 8) AS fdr FROM events GROUP BY 1")
def fdr_ratio(spark, sf):
    """AGG-22."""
    e = t(spark, sf, "events").withColumn("part", F.col("user_id") % 10)
    return rounded(fdr.decoy_ratio(e, F.col("event_type") == "error", ["part"]), "fdr", digits=8)


@query("SELECT user_id, floor(value / 20)::BIGINT AS bin, round(sum(value), 4) AS intensity FROM events WHERE value > 0 AND value < 200 GROUP BY ALL")
def bin_vector(spark, sf):
    """AGG-16."""
    return rounded(t(spark, sf, "events").where("value > 0 and value < 200").groupBy("user_id", F.floor(F.col("value") / 20).alias("bin")).agg(F.sum("value").alias("intensity")), "intensity")


@query("""WITH b AS (SELECT user_id, floor(value / 20)::BIGINT AS bin, sum(value) AS i FROM events WHERE value > 0 AND value < 200 GROUP BY ALL)
SELECT x.user_id AS a, y.user_id AS b, round(sum(x.i * y.i), 2) AS dot FROM b x JOIN b y ON x.bin = y.bin AND y.user_id = x.user_id + 1 GROUP BY ALL""")
def sparse_dot(spark, sf):
    """AGG-17: neighbouring users' vectors over shared bins."""
    b = t(spark, sf, "events").where("value > 0 and value < 200").groupBy("user_id", F.floor(F.col("value") / 20).alias("bin")).agg(F.sum("value").alias("i"))
    x, y = b.select(F.col("user_id").alias("a"), "bin", "i"), b.select(F.col("user_id").alias("b"), "bin", F.col("i").alias("j"), (F.col("user_id") - 1).alias("a"))
    return rounded(x.join(y, ["a", "bin"]).groupBy("a", "b").agg(F.sum(F.col("i") * F.col("j")).alias("dot")), "dot", digits=2)


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := -o_orderkey)) AS best, max(o_totalprice) AS price FROM orders GROUP BY 1")
def best_per_group(spark, sf):
    """WIN-12, AGG-18, SRT-06."""
    m = F.max(F.struct(F.col("o_totalprice").alias("p"), (-F.col("o_orderkey")).alias("k"))).alias("m")
    return t(spark, sf, "orders").groupBy("o_custkey").agg(m).select("o_custkey", (-F.col("m.k")).alias("best"), F.col("m.p").alias("price"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders QUALIFY place <= 3")
def topk_per_group(spark, sf):
    """WIN-11/13."""
    return ordered.top_k(t(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, "place").select("o_custkey", "o_orderkey", "place")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) = 1")
def distinct_first(spark, sf):
    """SRT-03/04."""
    return ordered.top_k(t(spark, sf, "lineitem"), ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")], 1).select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sorted_limit(spark, sf):
    """SRT-01/02."""
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("SELECT conv_id, turn, role || '_' || (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1) AS row_name FROM conversations")
def row_number_suffix(spark, sf):
    """WIN-10, RSH-10."""
    out = ordered.numbered(t(spark, sf, "conversations"), ["conv_id", "role"], [F.col("turn")], "n")
    return out.select("conv_id", "turn", F.concat_ws("_", "role", "n").alias("row_name"))


DAILY = "WITH d AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, sum(value) AS v FROM events GROUP BY ALL)"


def _daily(spark, sf):
    return t(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


@query(DAILY + """ SELECT event_type, day, round(v, 4) AS v FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)
QUALIFY v > lag(v, 1) OVER w AND v > lag(v, 2) OVER w AND v > lead(v, 1) OVER w AND v > lead(v, 2) OVER w""")
def local_maxima(spark, sf):
    """WIN-08."""
    return rounded(ordered.local_maxima(_daily(spark, sf), ["event_type"], "day", "v"), "v")


@query("""WITH d AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 0 ELSE value * 100 END AS v FROM events),
x AS (SELECT *, lag(v) OVER w AS p, lead(event_id) OVER w IS NULL AS e FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id FROM x WHERE NOT coalesce(v = 0 AND p IS NOT NULL AND p <> 0 AND p > 100 * (v + 1) AND NOT e, false)""")
def dropout_filter(spark, sf):
    """FLT-23."""
    d = t(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value") * 100).alias("v"))
    return ordered.without_dropouts(d, ["user_id"], "event_id", "v").select("user_id", "event_id")


@query("SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM conversations")
def group_when(spark, sf):
    """WIN-14."""
    return ordered.group_when(t(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "segment").select("conv_id", "turn", "segment")


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT s_suppkey, floor((r - 1) / ceil(n / 10.0))::INTEGER AS chunk FROM r""")
def equal_chunks(spark, sf):
    """WIN-15."""
    return ordered.equal_chunks(t(spark, sf, "supplier"), ["s_nationkey"], [F.col("s_acctbal"), F.col("s_suppkey")], 10, "chunk").select("s_suppkey", "chunk")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem)
SELECT l_orderkey, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6) AS weighted FROM r WHERE n <= 3 GROUP BY 1""")
def weighted_mean_top3(spark, sf):
    """AGG-25/26."""
    top = ordered.top_k(t(spark, sf, "lineitem"), ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber")], 3)
    return rounded(top.groupBy("l_orderkey").agg(A.weighted_mean("l_quantity", "l_extendedprice").alias("weighted")), "weighted", digits=6)


@query("""WITH x AS (SELECT l_partkey, n_regionkey, min(l_suppkey) AS supp FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT l_partkey, n_regionkey, supp FROM x QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n_regionkey DESC) = 1""")
def greedy_transfer(spark, sf):
    """JN-19."""
    s = t(spark, sf, "supplier").join(F.broadcast(t(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
    offers = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey").join(s, "l_suppkey").groupBy("l_partkey", "n_regionkey").agg(F.min("l_suppkey").alias("supp"))
    return joins.first_source(offers, ["l_partkey"], [F.col("n_regionkey").desc()])


RUNS = ["F", "O", "P"]


@query("SELECT o_orderpriority, " + ", ".join(f"max(CASE WHEN o_orderstatus = '{r}' THEN n END) AS {r}_n, max(CASE WHEN o_orderstatus = '{r}' THEN p END) AS {r}_p" for r in RUNS) + " FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n, max(o_totalprice) AS p FROM orders GROUP BY ALL) GROUP BY 1")
def pivot_by_file(spark, sf):
    """RSH-04/05, JN-05."""
    long = t(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("p"))
    return A.pivot_runs(long, ["o_orderpriority"], "o_orderstatus", RUNS, ["n", "p"])


@query("SELECT s_nationkey AS nation, 'supplier' AS origin, count(*) AS n FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, 'customer', count(*) FROM customer GROUP BY 1")
def union_merge(spark, sf):
    """SET-01/03."""
    one = lambda name, c: t(spark, sf, name).groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("n")).withColumn("origin", F.lit(name))
    return one("supplier", "s_nationkey").unionByName(one("customer", "c_nationkey"))


@query("SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def set_intersect(spark, sf):
    return t(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")).intersect(t(spark, sf, "customer").where("c_acctbal > 9000").select("c_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000")
def set_except(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).subtract(t(spark, sf, "supplier").where("s_acctbal > 7000").select("s_nationkey"))


@query("""WITH g AS (SELECT l_partkey, string_agg(DISTINCT lpad(l_suppkey::VARCHAR, 6, '0'), ';' ORDER BY lpad(l_suppkey::VARCHAR, 6, '0')) AS members FROM lineitem GROUP BY 1)
SELECT members, count(*) AS parts, min(l_partkey) AS first_part FROM g GROUP BY 1""")
def concat_members(spark, sf):
    """AGG-29/36, FN-29: groups named by their sorted members."""
    g = t(spark, sf, "lineitem").select("l_partkey", F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("m")).distinct()
    g = g.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_list("m")), ";").alias("members"))
    return g.groupBy("members").agg(F.count("*").alias("parts"), F.min("l_partkey").alias("first_part"))


@query("SELECT l_partkey, count(DISTINCT (l_returnflag, l_linestatus)) AS kinds FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def consistency_check(spark, sf):
    """AGG-34."""
    return t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct(F.struct("l_returnflag", "l_linestatus")).alias("kinds")).where("kinds > 1")


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE) + 1e-9) AS e FROM embeddings), s AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM n)
SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.p) + 1), lambda i: a.p[i] * ln(a.p[i] / b.p[i]))), 6) AS kl FROM s a JOIN s b ON b.vec_id = a.vec_id + 1""")
def kl_divergence(spark, sf):
    """FN-14/15."""
    s = t(spark, sf, "embeddings").select("vec_id", C.by_sum(F.transform("embedding", lambda x: F.abs(x.cast("double")) + 1e-9)).alias("p"))
    b = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    return s.join(b, "vec_id").select("vec_id", F.round(C.kl_divergence(F.col("p"), F.col("q")), 6).alias("kl"))


@query("""WITH u AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(corr(x, y), 5) AS r, round(max(x), 5) AS top FROM u GROUP BY 1""")
def pearson(spark, sf):
    """FN-17."""
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    e = t(spark, sf, "embeddings").select("vec_id", d("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(C.pearson(F.col("a"), F.col("b")), 5).alias("r"), F.round(F.array_max("a"), 5).alias("top"))


@query("""WITH v AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_type, count(v) FILTER (NOT isnan(v)) AS n, round(avg(v) FILTER (NOT isnan(v)), 6) AS m, count(*) FILTER (v IS NULL OR isnan(v)) AS missing FROM v GROUP BY 1""")
def null_safe_stats(spark, sf):
    """NaN is missing everywhere; FLT-16, AGG-10."""
    i = F.col("event_id")
    v = C.known(F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("value")))
    out = t(spark, sf, "events").select("event_type", v.alias("v")).groupBy("event_type").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.count_if(F.col("v").isNull()).alias("missing"))
    return rounded(out, "m", digits=6)


@query("""WITH p AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS tp, count(*) FILTER (l_returnflag <> 'R') AS fp FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT l_suppkey, round(tp / (tp + fp), 8) AS precision, tp, fp FROM p""")
def classifier_metrics(spark, sf):
    """Precision alone; AGG-41 is ``confusion_metrics``."""
    g = t(spark, sf, "lineitem").where("l_quantity > 25").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("tp"), F.count_if(F.col("l_returnflag") != "R").alias("fp"))
    return rounded(g.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))), "precision", digits=8)


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""")
def linear_fit_r2(spark, sf):
    """Lines by group, in sample."""
    out = t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"), F.regr_intercept("l_extendedprice", "l_quantity").alias("intercept"), F.regr_r2("l_extendedprice", "l_quantity").alias("r2"))
    return rounded(rounded(rounded(out, "slope"), "intercept", digits=2), "r2", digits=6)


@query("""WITH b AS (SELECT l_suppkey, abs(l_quantity - 25) / 10 AS z FROM lineitem)
SELECT l_suppkey, round(count(*) FILTER (z < 1) / count(*), 8) AS band0, round(count(*) FILTER (z >= 1 AND z < 2) / count(*), 8) AS band1, round(count(*) FILTER (z >= 2) / count(*), 8) AS band2 FROM b GROUP BY 1""")
def error_bands(spark, sf):
    """Three bands; AGG-39 is ``error_band_shares``."""
    z = F.abs(F.col("l_quantity") - 25) / 10
    share = lambda c, n: (F.count_if(c) / F.count("*")).alias(n)
    out = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(share(z < 1, "band0"), share((z >= 1) & (z < 2), "band1"), share(z >= 2, "band2"))
    return rounded(out, "band0", "band1", "band2", digits=8)


@query("""SELECT l_suppkey, round(0.9 * least(stddev_samp(l_extendedprice), (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / 1.34) * pow(count(*), -0.2), 3) AS bandwidth FROM lineitem GROUP BY 1""")
def kernel_bandwidth(spark, sf):
    """AGG-38."""
    return rounded(A.kernel_bandwidth(t(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", "bandwidth"), "bandwidth", digits=3)


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def json_cells(spark, sf):
    """JSON cells."""
    return t(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""WITH s AS (SELECT p_partkey, upper(translate(p_name, ' ', '')) AS seq FROM part),
f AS (SELECT p_partkey, string_split_regex(regexp_replace(regexp_replace(seq, '([KR])', '\\1|', 'g'), '([KR])\\|P', '\\1P', 'g'), '\\|') AS parts FROM s)
SELECT p_partkey, peptide, count(*) AS n FROM (SELECT p_partkey, unnest(list_filter(parts, lambda x: x <> '')) AS peptide FROM f) GROUP BY ALL""".replace("\\\\", "\\"))
def digestion(spark, sf):
    """FN-09, RSH-03."""
    s = t(spark, sf, "part").select("p_partkey", F.upper(F.translate("p_name", " ", "")).alias("seq"))
    d = s.select("p_partkey", F.explode(C.digest(F.col("seq"), "trypsin", 0)).alias("d"))
    return d.select("p_partkey", F.col("d.peptide").alias("peptide")).groupBy("p_partkey", "peptide").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_partkey AS pep, list_sort(list_distinct(list(l_suppkey))) AS prots FROM lineitem GROUP BY 1)
SELECT array_to_string(prots, ';') AS protein_group, count(*) AS peptides, CASE WHEN len(prots) = 1 THEN 'unique' ELSE 'shared' END AS evidence FROM m GROUP BY ALL""")
def protein_evidence(spark, sf):
    """Peptides by the set of proteins that hold them."""
    pairs = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("peptide"), F.col("l_suppkey").alias("protein"))
    return evidence_classes(pairs)


@query()
def protein_inference(spark, sf):
    """UDF-26: minimal set of proteins that explains the peptides, by greedy cover inside connected groups."""
    pairs = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("peptide"), F.col("l_suppkey").alias("protein"))
    return infer_groups(pairs)


@query()
def dtw_distance(spark, sf):
    """FN-18: neighbouring embeddings warped onto each other."""
    e = t(spark, sf, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "distance": [signal.dtw_distance(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(b["a"], b["b"], strict=True)]})

    return pairs.mapInPandas(run, "vec_id bigint, distance double")


@query()
def spline_alignment(spark, sf):
    """UDF-02/03/33: the best smoothing spline of each event type's daily sums."""
    d = t(spark, sf, "events").groupBy("event_type", F.floor((micros() / 1000000) / 21600).cast("double").alias("x")).agg(F.sum("value").alias("y"))
    return signal.align_runs(d, "event_type", "event_type string, lambda double, r2 double, points int")


@query()
def peak_area(spark, sf):
    """UDF-05..09: baseline, smoothing, peak picking and area of each user's trace."""
    d = t(spark, sf, "events").groupBy("user_id", F.floor((micros() / 1000000) / 86400).cast("double").alias("x")).agg(F.sum("value").alias("y"))

    def run(key, part):
        part = part.sort_values("x")
        x, y = part["x"].to_numpy(), part["y"].to_numpy()
        y = np.maximum(0.0, y - signal.als_baseline(y))
        peaks = signal.pick_peaks(x, y)
        return pd.DataFrame([(key[0], len(peaks), max((h for _, h in peaks), default=0.0), signal.gaussian_area(x - x.mean(), y)[3])], columns=["user_id", "peaks", "top", "area"])

    return d.groupBy("user_id").applyInPandas(run, "user_id bigint, peaks int, top double, area double")


@query("""WITH d AS (SELECT doc_id AS id, n_chars, quality = 1 AS found, toxic = 1 AS decoy FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (ORDER BY n_chars, id) AS r, count(*) OVER () AS all_n FROM d), c AS (SELECT floor((r - 1) / ceil(all_n / 10.0)) AS chunk, count(*) AS n, count(*) FILTER (found AND NOT decoy) AS t, count(*) FILTER (found AND decoy) AS d FROM r GROUP BY 1),
f AS (SELECT *, unnest(range(0, least(t, d) + 1)) AS f FROM c), w AS (SELECT chunk, f, lgamma(n - t + f + 1) - lgamma(f + 1) - lgamma(n - t + 1) + lgamma(t - f + 1) - lgamma(d - f + 1) - lgamma(t - d + 1) AS w FROM f WHERE t >= d),
e AS (SELECT chunk, sum(f * exp(w - m)) / sum(exp(w - m)) AS e FROM (SELECT *, max(w) OVER (PARTITION BY chunk) AS m FROM w) GROUP BY 1), v AS (SELECT (SELECT sum(e) FROM e) / (SELECT nullif(sum(t), 0) FROM c) AS v)
SELECT round(CASE WHEN v > 0 AND v <= 1 THEN v ELSE 1 END, 6) AS fdr FROM v""")
def mayu_fdr(spark, sf):
    """AGG-23, FN-27: chunks of equal size by length, ranks from running sums over ranges."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars").join(t(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"), "id")
    value = fdr.mayu_fdr(d, "n_chars", F.col("toxic") == 1, F.col("quality") == 1)
    return spark.createDataFrame([(round(float(value), 6),)], "fdr double")


@query()
def gbt_score(spark, sf):
    """UDF-18/19: gradient-boosted trees over standardised features, scores turned into q-values."""
    from ..plans.scoring import boosted_scores

    rows = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "n_chars", F.size(F.split("text", "\n")).alias("lines"), F.length(F.regexp_replace("text", r"[\p{L}\s]", "")).alias("marks")), "doc_id")
    return boosted_scores(rows, ["n_chars", "lines", "marks"], "quality", "doc_id")


LETTERS = "".join(masses.RESIDUES)
MASS_OF = "map {" + ", ".join(f"'{k}': {v}" for k, v in masses.RESIDUES.items()) + "}"
SEQUENCES = f"seqs AS (SELECT p_partkey, regexp_replace(upper(p_type || p_name), '[^{LETTERS}]', '', 'g') AS sequence FROM part)"
MASSES = f"list_transform(string_split(sequence, ''), lambda r: ({MASS_OF})[r]::DOUBLE)"
IONS = f"""{SEQUENCES}, ms AS (SELECT DISTINCT sequence, {MASSES} AS m FROM seqs),
cuts AS (SELECT sequence, m, unnest(range(1, len(m))) AS number FROM ms),
ions AS (SELECT sequence, 'b' AS series, number::INTEGER AS number, list_sum(m[1:number]) + {C.PROTON} AS mz FROM cuts
UNION ALL SELECT sequence, 'y', number::INTEGER, list_sum(m[len(m) - number + 1:]) + {masses.WATER + C.PROTON} FROM cuts)"""


def _sequences(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.regexp_replace(F.upper(F.concat("p_type", "p_name")), f"[^{LETTERS}]", "").alias("sequence"))


def _peaks(spark, sf):
    """Each user's events as one spectrum."""
    return t(spark, sf, "events").select(F.col("user_id").alias("spectrum"), (F.col("value") * 10).alias("mz"), (F.col("event_id") % 97 + 1).cast("double").alias("intensity"))


def _spectra(spark, sf):
    peak = F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("p")
    return _peaks(spark, sf).groupBy("spectrum").agg(peak).select("spectrum", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


@query(f"WITH {SEQUENCES} SELECT p_partkey, sequence, round(list_sum({MASSES}) + {masses.WATER}, 6) AS mass FROM seqs")
def peptide_masses(spark, sf):
    """FN-11: neutral masses of sequences."""
    s = _sequences(spark, sf)
    return s.select("p_partkey", "sequence", F.round(masses.peptide_mass(F.col("sequence")), 6).alias("mass"))


@query(f"WITH {IONS} SELECT sequence, series, number, round(mz, 4) AS mz FROM ions")
def fragment_ions(spark, sf):
    """UDF-21: b and y ions of each distinct sequence."""
    s = _sequences(spark, sf).select("sequence").distinct()
    return rounded(s.select("sequence", F.explode(masses.fragments(F.col("sequence"))).alias("f")).select("sequence", "f.*"), "mz")


LIBRARY = f"""{IONS}, psms AS (SELECT DISTINCT user_id % 3 AS file, user_id AS spectrum, sequence FROM events JOIN seqs ON p_partkey = user_id),
peaks AS (SELECT user_id AS spectrum, value * 10 AS mz, (event_id % 97 + 1)::DOUBLE AS intensity FROM events),
tops AS (SELECT spectrum, max(intensity) AS top FROM peaks GROUP BY 1),
lib AS (SELECT file, sequence, series, number, count(*) AS matches, avg(intensity / top) AS mean_share, max(intensity / top) AS max_share, avg(p.mz - i.mz) AS mean_error,
min(intensity / top) AS min_share, stddev_samp(intensity / top) / avg(intensity / top) AS cv_share, avg(p.mz) AS mean_mz, stddev_samp(p.mz) / avg(p.mz) AS cv_mz, avg(abs(p.mz - i.mz)) AS mean_abs_error
FROM psms JOIN ions i USING (sequence) JOIN peaks p ON p.spectrum = psms.spectrum AND p.mz BETWEEN i.mz - 2 AND i.mz + 2 JOIN tops ON tops.spectrum = psms.spectrum GROUP BY ALL)"""


def _library(spark, sf):
    e = t(spark, sf, "events").select("user_id").distinct()
    psms = e.join(_sequences(spark, sf), F.col("user_id") == F.col("p_partkey")).select((F.col("user_id") % 3).alias("file"), F.col("user_id").alias("spectrum"), "sequence")
    return spectra.spectral_library(psms, _peaks(spark, sf), 2.0)


@query(f"""WITH {LIBRARY} SELECT file, sequence, series, number, matches, round(mean_share, 6) AS mean_share, round(max_share, 6) AS max_share, round(mean_error, 5) AS mean_error,
round(min_share, 6) AS min_share, round(cv_share, 6) AS cv_share, round(mean_mz, 4) AS mean_mz, round(cv_mz, 7) AS cv_mz, round(mean_abs_error, 5) AS mean_abs_error FROM lib""")
def spectral_library(spark, sf):
    """UDF-28, JN-14, AGG-27."""
    out = rounded(_library(spark, sf), "mean_share", "max_share", "min_share", "cv_share", digits=6)
    return rounded(rounded(rounded(out, "mean_error", "mean_abs_error", digits=5), "mean_mz"), "cv_mz", digits=7)


@query(f"""WITH {LIBRARY} SELECT sequence, series, number, count(DISTINCT file) AS files, round(median(mean_share), 6) AS share FROM lib
GROUP BY ALL HAVING count(DISTINCT file) >= 2""")
def consensus_library(spark, sf):
    """UDF-29: fragments that several files agree on."""
    out = spectra.consensus_library(_library(spark, sf), 2)
    return rounded(out.select("sequence", F.explode("fragments").alias("f")).select("sequence", "f.*"), "share", digits=6)


@query()
def spectrum_scores(spark, sf):
    """UDF-21/22, JN-11/16: candidates by mass, three scores of peptides and decoys; masses are dealt to users."""
    x = _spectra(spark, sf).withColumn("mass", 1000.0 + F.col("spectrum") * 37 % 1000)
    return spectra.score_spectra(x, _sequences(spark, sf), 5.0, 0.5)


#: Fixed value: the search's default number of random spectra.
RANDOM_SPECTRA = 10_000


@query()
def charge_states(spark, sf):
    """UDF-20: charges whose isotope ladders are longer than random spectra hold, once for spectra of equal peaks."""

    def charges(mz):
        return spectra.charge_states(mz, range(1, 5), rounds=RANDOM_SPECTRA)

    def run(batches):
        for b in batches:
            got = list(spectra.once_each(charges, b["mz"]))
            yield pd.DataFrame({"spectrum": b["spectrum"], "charges": [[z for z, _, _ in g] for g in got], "p": [[p for _, _, p in g] for g in got]})

    # Equal spectra stand one after the other, and by their numbers of peaks, of which random ones have as many.
    x = dealt(_spectra(spark, sf).select("spectrum", "mz"), "mz").sortWithinPartitions(F.size("mz"), "mz")
    return x.mapInPandas(run, "spectrum bigint, charges array<int>, p array<double>")


@query()
def label_efficiency(spark, sf):
    """UDF-12/23, FN-13/14: the N-15 share whose isotope pattern is nearest to a measured one. Measured are binomial draws of the
    nitrogens' isotopes over the other elements' pattern, as shares of 20,000 ions, so the estimate has a real error to make."""
    s = dealt(_sequences(spark, sf).withColumn("share", F.lit(0.9) + (F.col("p_partkey") % 90) / 1000), "p_partkey")

    def run(batches):
        for b in batches:
            for q, g in b.groupby("sequence", sort=False, dropna=False):
                drawn = np.array([spectra.drawn_pattern(q, e, 20_000, seed=k) for e, k in zip(g["share"], g["p_partkey"], strict=True)])
                e, kl = spectra.label_efficiencies(q, drawn)
                yield pd.DataFrame({"p_partkey": g["p_partkey"], "share": g["share"], "efficiency": np.round(e, 4), "kl": kl})

    return s.mapInPandas(run, "p_partkey bigint, share double, efficiency double, kl double")


@query()
def wavelet_peaks(spark, sf):
    """UDF-08: peaks of each user's daily trace by wavelet transform."""
    d = t(spark, sf, "events").groupBy("user_id", F.floor((micros() / 1000000) / 86400).cast("int").alias("x")).agg(F.sum("value").alias("y"))
    d = d.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p")).select("user_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))

    def run(batches):
        for b in batches:
            rows = []
            for user, x, y in zip(b["user_id"], b["x"], b["y"], strict=True):
                full = np.zeros(int(x[-1] - x[0]) + 1)
                full[np.asarray(x) - x[0]] = y
                rows += [(user, *peak) for peak in signal.wavelet_peaks(x[0] + np.arange(len(full), dtype=float), full)]
            yield pd.DataFrame(rows, columns=["user_id", "position", "height", "sd"])

    return d.mapInPandas(run, "user_id bigint, position double, height double, sd double")


@query("""WITH p AS (SELECT user_id AS spectrum, value * 10 AS mz, (event_id % 97 + 1)::DOUBLE AS y FROM events), o AS (SELECT *, row_number() OVER w AS i, lag(y) OVER w AS a, lead(y) OVER w AS z FROM p WINDOW w AS (PARTITION BY spectrum ORDER BY mz, y)),
g AS (SELECT *, sum(CASE WHEN y <= a AND y < z THEN 1 ELSE 0 END) OVER (PARTITION BY spectrum ORDER BY i) AS part FROM o)
SELECT spectrum, round(sum(y * mz) / sum(y), 3) AS mz, max(y) AS intensity FROM g GROUP BY spectrum, part HAVING max(y) > 20""")
def centroid_spectra(spark, sf):
    """UDF-24: profile peaks as centroids."""

    def run(batches):
        for b in batches:
            got = [spectra.centroids(np.asarray(m, float), np.asarray(i, float), 20.0) for m, i in zip(b["mz"], b["intensity"], strict=True)]
            rows = [(s, float(m), float(h)) for s, (ms, hs) in zip(b["spectrum"], got, strict=True) for m, h in zip(ms, hs, strict=True)]
            yield pd.DataFrame(rows, columns=["spectrum", "mz", "intensity"])

    return rounded(_spectra(spark, sf).mapInPandas(run, "spectrum bigint, mz double, intensity double"), "mz", digits=3)


@query()
def logistic_q_values(spark, sf):
    """UDF-14: logistic curve through the q-values of score bins."""
    bins = fdr.binned_pep(_scored(spark, sf), "score", F.col("toxic") == 1, 500.0)
    return spark.createDataFrame([fdr.logistic_q(bins)], "top double, slope double, middle double")


@query("""WITH m AS (SELECT l_suppkey AS a, median(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS o, median(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS f FROM lineitem GROUP BY 1)
SELECT 0 AS part, '000000' AS key, 'MTD' || chr(9) || 'mzTab-version' || chr(9) || '1.0.0' AS line UNION ALL SELECT 0, '000001', 'MTD' || chr(9) || 'mzTab-mode' || chr(9) || 'Summary' UNION ALL SELECT 0, '000002', 'MTD' || chr(9) || 'mzTab-type' || chr(9) || 'Quantification'
UNION ALL SELECT 0, '000003', 'MTD' || chr(9) || 'ms_run[1]-location' || chr(9) || 'O' UNION ALL SELECT 0, '000004', 'MTD' || chr(9) || 'ms_run[2]-location' || chr(9) || 'F' UNION ALL SELECT 0, '000005', ''
UNION ALL SELECT 1, '', 'PRH' || chr(9) || 'accession' || chr(9) || 'O_abundance' || chr(9) || 'F_abundance' UNION ALL SELECT 3, '', ''
UNION ALL SELECT 2, '["' || a || '"]', 'PRT' || chr(9) || a || chr(9) || coalesce(o::VARCHAR, 'null') || chr(9) || coalesce(f::VARCHAR, 'null') FROM m""")
def mztab_report(spark, sf):
    """SNK-07, RSH-09: the lines of an mzTab file, with suppliers as proteins and their orders' states as runs."""
    rows = A.grouped_values(t(spark, sf, "lineitem"), ["l_suppkey", "l_linestatus"], {"abundance": ("median", "l_quantity")})
    runs = A.pivot_runs(rows, ["l_suppkey"], "l_linestatus", ["O", "F"], ["abundance"]).withColumnsRenamed({"l_suppkey": "accession"})
    return mztab.mztab_lines(spark, {"mzTab-version": "1.0.0", "mzTab-mode": "Summary", "mzTab-type": "Quantification", "ms_run[%i]-location": ["O", "F"]}, {"protein": (runs, ["accession"])})
