"""Exact similarity search of sparse vectors: an inverted index over bins with prefix filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What rounding may take from a norm: prefixes are longer by it, so that no pair at the threshold is lost.
SLACK = 1e-9


def unit_vectors(bins: DataFrame, key: str, bin_: str, weight: str) -> DataFrame:
    """id, bin, w: the bins of each vector, of length 1. Weights of a repeated bin are added; null, NaN and zero weights take no part."""
    w = F.col(weight).cast("double")
    known = bins.where(w.isNotNull() & ~F.isnan(w) & F.col(key).isNotNull() & F.col(bin_).isNotNull()).select(F.col(key).alias("id"), F.col(bin_).alias("bin"), w.alias("w"))
    # Dealt by vector once, for its bins, its norm and their join.
    rows = known.repartition("id").groupBy("id", "bin").agg(F.sum("w").alias("w")).where("w <> 0")
    norms = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norms, "id").select("id", "bin", (F.col("w") / F.col("norm")).alias("w"))


def prefixes(vectors: DataFrame, threshold: float) -> DataFrame:
    """id, bin, w of each vector's prefix, its bins from the rarest on, as long as what is left has a norm of ``threshold``, each
    with ``bins`` and ``ws`` of the whole vector in that order.

    Bins are in one order for all vectors (by how many hold them, then by bin). If two vectors share no bin of both prefixes, all
    that they share lies in the rest of one of them, whose norm, and so their product, is below the threshold. The bins of one
    vector are one array, bounded by the bins that a spectrum has.
    """
    often = vectors.groupBy("bin").agg(F.count("*").alias("often"))
    order = Window.partitionBy("id").orderBy(F.col("often").desc(), F.col("bin").desc())
    rest = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = vectors.join(often, "bin").withColumn("rest", rest).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "bin", "w", "rest"))).alias("x"))
    first = F.filter("x", lambda e: e["rest"] >= threshold * threshold - SLACK)
    return whole.select("id", F.explode(first).alias("e"), F.col("x.bin").alias("bins"), F.col("x.w").alias("ws")).select("id", "e.bin", "e.w", "bins", "ws")


def similar(bins: DataFrame, is_query: Column, threshold: float, key: str = "id", bin_: str = "bin", weight: str = "w") -> DataFrame:
    """query_id, id, cosine of all pairs of a query and another vector whose cosine is ``threshold`` (above 0) or more.

    ``bins``: rows of key, bin and weight (0 or more); ``is_query`` is a condition on the column ``id``. The index holds the prefixes alone; queries
    look their own prefixes up in it, and the pairs that meet are multiplied there, over all their bins. Nothing is capped: a
    bin that most vectors hold is the last of every prefix. Vectors without a bin have no partner.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be above 0")
    vectors = unit_vectors(bins, key, bin_, weight)
    index = prefixes(vectors, threshold)
    # One row for each prefix bin, with its whole vector in the order of all bins: pairs that meet are multiplied where they meet, and no pair
    # is shuffled but those near enough, once for each prefix bin that both have.
    asked = index.where(is_query).select(F.col("id").alias("query_id"), "bin", F.col("w").alias("v"), F.col("bins").alias("q_bins"), F.col("ws").alias("q_ws"))
    met = index.join(asked.hint("merge"), "bin").where("query_id <> id")
    # Most pairs share that bin alone, whose product tells; the others are multiplied bin by bin of the vector, in its order.
    more = F.expr("arrays_overlap(array_remove(bins, bin), array_remove(q_bins, bin))")
    met = met.where(more | (F.col("v") * F.col("w") >= threshold - SLACK))
    at = F.expr("transform(bins, b -> array_position(q_bins, b))")
    products = F.zip_with("ws", at, lambda w, i: F.when(i > 0, w * F.expr("q_ws")[(i - 1).cast("int")]).otherwise(0.0))
    cosine = F.when(more, F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.col("v") * F.col("w"))
    near = met.select("query_id", "id", cosine.alias("cosine")).where(F.col("cosine") >= threshold - SLACK)
    return near.groupBy("query_id", "id").agg(F.max("cosine").alias("cosine"))
