"""Sharding in Hilbert-curve order: quantise metadata, sort by curve index, cut equal runs. JVM only.

Three dimensions (source, language, length) are quantised to ``2 ** bits`` steps each and the cell's index on
a Hilbert curve orders the rows, so that every run of the order, and so every shard, spans few values of each
dimension and a reader prunes shards by min/max statistics in any of them.

Global ranks need no global sort and no window over a whole cell. Rows are counted by (cell, part), where a
part is one of ``parts`` hash classes of doc_id; offsets of cells come from at most ``8 ** bits`` counts, those
of parts from at most ``parts`` counts per cell; only inside one (cell, part) are rows ordered, so that a cell
that holds a third of all rows is dealt to ``parts`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index of a point on the Hilbert curve of ``len(dims)`` dimensions with ``bits`` bits each.

    The axes are turned into the curve's transposed index bit by bit, from the highest (undoing the
    rotations of each level), and Gray-decoded; the bits are then interleaved.
    """
    n = len(dims)
    long = lambda v: F.lit(v).cast("bigint")
    none = F.array().cast("array<bigint>")
    lows = [(1 << b) - 1 for b in range(bits - 1, 0, -1)]
    steps = [F.struct(long(low).alias("low"), F.lit(i).alias("axis")) for low in lows for i in range(n)]

    def undo(x: Column, s: Column) -> Column:
        """One axis at one level: flip the lower bits of the first axis, or swap them with this axis."""
        first, own, low = F.get(x, F.lit(0)), F.get(x, s["axis"]), s["low"]
        on = own.bitwiseAND(low + 1) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(j == 0, F.when(on, v.bitwiseXOR(low)).otherwise(v.bitwiseXOR(swap))).when((j == s["axis"]) & ~on, v.bitwiseXOR(swap)).otherwise(v))

    def let(value: Column, body) -> Column:
        """``body`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    point = F.array(*[d.cast("bigint") for d in dims])
    point = F.aggregate(F.array(*steps), point, undo) if steps else point
    point = F.aggregate(point, none, lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.get(acc, F.size(acc) - 1), long(0))))))
    fix = lambda y: F.aggregate(F.array(*map(long, lows)) if lows else none, long(0), lambda a, low: F.when(F.get(y, F.lit(n - 1)).bitwiseAND(low + 1) != 0, a.bitwiseXOR(low)).otherwise(a))
    point = let(point, lambda y: let(fix(y), lambda m: F.transform(y, lambda v: v.bitwiseXOR(m))))
    slots = F.array(*[F.struct(long(1 << b).alias("bit"), F.lit(i).alias("axis")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return let(point, lambda y: F.aggregate(slots, long(0), lambda h, s: h * 2 + F.when(F.get(y, s["axis"]).bitwiseAND(s["bit"]) != 0, long(1)).otherwise(long(0))))


def quantised(bits: int) -> list[Column]:
    """Source and language by a hash that only names steps, length by its logarithm (half octaves)."""
    step = 1 << bits
    by_hash = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(step))
    size = F.coalesce(F.length("text"), F.lit(0))
    return [by_hash("source"), by_hash("lang"), F.least(F.lit(step - 1), F.floor(2 * F.log2(size + 1)))]


def shard_documents(docs: DataFrame, shards: int = 8, bits: int = 5, parts: int = 256, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with size, text_crc32, law, shard, slot, grown_shard and the cell's curve_index.

    Law ``rows``: of n rows shard s takes ranks ceil(s * n / shards) and on, so that counts differ by one at
    most; slot counts from 0 within a shard. Within a cell rows go by part, doc_id, then text_crc32: repeated
    rows are interchangeable, so either order is the same result. Null text: size 1, crc of the empty text. An
    empty table gives no rows. grown_shard is null, as this law moves rows when a shard is added.
    """
    h, g = fresh(docs, "s_cell", "s_part")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, F.col("doc_id").alias("s_doc"), hilbert_index(quantised(bits), bits).alias(h), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias(g), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    counts = rows.groupBy(h, g).agg(F.count("*").alias("s_n"))
    before = lambda w: F.coalesce(F.sum("s_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.groupBy(h).agg(F.sum("s_n").alias("s_n"))
    # At most 8 ** bits rows, whatever the input: the one place where a single task sees all cells.
    cells = cells.select(h, before(Window.orderBy(h)).alias("s_cells_before"), F.sum("s_n").over(Window.partitionBy()).alias("s_total"))
    offsets = counts.select(h, g, before(Window.partitionBy(h).orderBy(g)).alias("s_parts_before")).join(cells, h).select(h, g, (F.col("s_cells_before") + F.col("s_parts_before")).alias("s_base"), "s_total")
    local = F.row_number().over(Window.partitionBy(h, g).orderBy("s_doc", "text_crc32")) - 1
    ranked = rows.withColumn("s_local", local).join(offsets, [h, g]).withColumn("s_rank", F.col("s_base") + F.col("s_local"))
    shard = F.expr(f"cast((s_rank * {shards}) div s_total as int)")
    ranked = ranked.withColumn("s_shard", shard)
    first = F.expr(f"(s_shard * s_total + {shards - 1}) div {shards}")
    return ranked.select(*keep, "size", "text_crc32", F.lit("rows").alias("law"), F.col("s_shard").alias("shard"), (F.col("s_rank") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col(h).alias("curve_index"))
