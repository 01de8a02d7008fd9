"""Rows that fail do not stop a run: each row's function gives a result or an error row in a second frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .lineage import cut

#: Characters of a message that an error row keeps.
MESSAGE = 500


@dataclass
class Outcome:
    """``good``: results so far; ``bad``: keys, stage, kind and message of every row that failed at some stage; ``counts``: (good, bad) by stage.

    Both frames come from one materialised pass, so a function runs once for each row, whichever frame is read.
    """

    good: DataFrame
    bad: DataFrame | None = None
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)

    def map(self, stage: str, keys: list[str], f: Callable[[Any], dict | list[dict] | None], schema: str) -> Outcome:
        """``f`` of each good row (a Row of its columns): a row, several, or none, of ``schema``; what it raises is an error row.

        Rows go through in Arrow batches. ``keys`` are columns of the input, which the error rows keep as they are.
        """
        out = StructType.fromDDL(schema)
        taken = {c.lower() for c in self.good.columns}
        if {k.lower() for k in keys} - taken:
            raise ValueError(f"no such columns: {sorted(set(keys) - set(self.good.columns))}")
        kinds = {k: self.good.schema[k].dataType.simpleString() for k in keys}
        names = out.fieldNames()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shape_of_out = to_arrow_type(out)
            for b in batches:
                made = []
                for values in b.to_pylist():  # Arrow's own values: integers beside nulls stay integers
                    key = values.pop("__key")
                    try:
                        got = f(Row(**values))
                        got = [got] if isinstance(got, dict) else got or []
                        made += [(key, True, None, None, {n: r[n] for n in names}) for r in got]
                    except Exception as e:  # the row's, whatever it is: it becomes a row of the other frame
                        made.append((key, False, type(e).__name__, str(e)[:MESSAGE], None))
                cols = list(zip(*made, strict=True)) if made else [()] * 5
                kinds_of = (pa.string(), pa.bool_(), pa.string(), pa.string(), shape_of_out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_of, strict=True)], ["__key", "ok", "kind", "message", "out"])

        # Keys pass as text of their own, so that integers with nulls do not become floats.
        key = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
        shape = ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keys))
        rows = self.good.withColumn("__key", key).mapInArrow(run, f"__key string, ok boolean, kind string, message string, out struct<{', '.join(f'`{x.name}`:{x.dataType.simpleString()}' for x in out)}>")
        seen = Observation(f"tolerant {stage}")
        rows = cut(rows.observe(seen, F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad")))
        own = F.from_json("__key", shape)
        bad = rows.where("NOT ok").select(*[own[f"k{i}"].alias(k) for i, k in enumerate(keys)], F.lit(stage).alias("stage"), "kind", "message")
        return self._next(rows.where("ok").select("out.*"), bad, stage, seen)

    def check(self, stage: str, keys: list[str], ok: Column, message: Column) -> Outcome:
        """Good rows of which ``ok`` holds stay; the others are error rows with ``message`` (kind ``Check``). On the JVM, in one pass."""
        rows = self.good.withColumn("__ok", F.coalesce(ok, F.lit(False)))
        seen = Observation(f"tolerant {stage}")
        rows = cut(rows.observe(seen, F.count_if("__ok").alias("good"), F.count_if(~F.col("__ok")).alias("bad")))
        bad = rows.where("NOT __ok").select(*keys, F.lit(stage).alias("stage"), F.lit("Check").alias("kind"), F.left(message.cast("string"), F.lit(MESSAGE)).alias("message"))
        return self._next(rows.where("__ok").drop("__ok"), bad, stage, seen)

    def _next(self, good: DataFrame, bad: DataFrame, stage: str, seen: Observation) -> Outcome:
        n = seen.get
        return Outcome(good, bad if self.bad is None else self.bad.unionByName(bad, allowMissingColumns=True), {**self.counts, stage: (n["good"], n["bad"])})


def tolerant(df: DataFrame) -> Outcome:
    """Starts a chain of stages over ``df``."""
    return Outcome(df)
