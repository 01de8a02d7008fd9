"""Rows as one tab-separated table from many tasks: a Spark data source writer with a commit protocol.

Each task streams its rows into a file of its own in a hidden folder. Only when all tasks have ended are their files renamed
into the table's folder, in order, behind one file that holds the header; what a failed, repeated or abandoned task has written goes. The
files in order of their names are one table with one header, also after rows have been appended.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BUFFER = 1 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _cell(v, missing: str) -> str:
    """A value as text: arrays joined by ``;``, missing ones and NaN as ``missing``; tabs and line breaks become spaces."""
    if v is None or v != v:
        return missing
    if isinstance(v, (list, tuple)):
        return ";".join(_cell(x, missing) for x in v)
    return re.sub(r"[\t\r\n]", " ", repr(v) if isinstance(v, float) else str(v))


@dataclass
class Part(WriterCommitMessage):
    name: str
    task: int
    rows: int


class RowStreamWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, missing: str):
        self.path, self.columns, self.overwrite, self.missing = path.rstrip("/"), [f.name for f in schema], overwrite, missing
        self.hidden = f"_writing-{uuid.uuid4().hex}"
        # Made here alone: a task that goes on after the call was abandoned cannot make it again.
        store, top = _store(self.path)
        store.create_dir(f"{top}/{self.hidden}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> Part:
        store, top = _store(self.path)
        name, n, held, size = f"{self.hidden}/{uuid.uuid4().hex}", 0, [], 0
        with store.open_output_stream(f"{top}/{name}") as out:
            for row in iterator:
                held.append(("\t".join(_cell(v, self.missing) for v in row) + "\n").encode())
                n, size = n + 1, size + len(held[-1])
                if size >= BUFFER:
                    out.write(b"".join(held))
                    held, size = [], 0
            out.write(b"".join(held))
        return Part(name, TaskContext.get().partitionId(), n)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, top = _store(self.path)
        there = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.base_name.startswith("part-"))
        if self.overwrite:
            for name in there:
                store.delete_file(f"{top}/{name}")
            there = []
        store.create_dir(top, recursive=True)
        first = int(there[-1][5:15]) + 1 if there else 0
        if not there:
            with store.open_output_stream(f"{top}/part-{0:010d}.tsv") as out:
                out.write(("\t".join(self.columns) + "\n").encode())
            first = 1
        elif (head := self._header(store, f"{top}/{there[0]}")) != self.columns:
            self._clear(store, top)
            raise ValueError(f"the table has columns {head}, not {self.columns}")
        for k, m in enumerate(sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.task)):
            store.move(f"{top}/{m.name}", f"{top}/part-{first + k:010d}.tsv")
        self._clear(store, top)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*_store(self.path))

    def _header(self, store, path: str) -> list[str]:
        with store.open_input_stream(path) as f:
            return f.read(BUFFER).decode().split("\n", 1)[0].split("\t")

    def _clear(self, store, top: str) -> None:
        from pyarrow import fs

        for last in (False,) * 20 + (True,):
            try:
                if store.get_file_info(f"{top}/{self.hidden}").type == fs.FileType.Directory:
                    store.delete_dir(f"{top}/{self.hidden}")
                return
            except OSError:  # a task that still runs has put a file there meanwhile
                if last:
                    raise
                time.sleep(0.1)


class RowStream(DataSource):
    """``df.write.format("row_stream")``: option ``missing``, the text of missing values (NaN)."""

    @classmethod
    def name(cls) -> str:
        return "row_stream"

    def writer(self, schema: StructType, overwrite: bool) -> RowStreamWriter:
        return RowStreamWriter(self.options["path"], schema, overwrite, self.options.get("missing", "NaN"))


def stream_rows(df: DataFrame, path: str, append: bool = True, missing: str = "NaN") -> None:
    """``df`` as one table under ``path``, in the order of its partitions; with ``append`` behind what is there, else in its place.

    All rows of a call are there or none. Columns that differ from those of a table appended to are an error. The path is
    opened by pyarrow's file systems, on the driver and the executors.
    """
    df.sparkSession.dataSource.register(RowStream)
    df.write.format("row_stream").mode("append" if append else "overwrite").option("missing", missing).save(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table as text columns; the header file gives their names."""
    store, top = _store(path.rstrip("/"))
    with store.open_input_stream(f"{top}/part-{0:010d}.tsv") as f:
        names = f.read(BUFFER).decode().rstrip("\n").split("\t")
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(f"{path}/part-*.tsv", sep="\t", header=False, quote="", pathGlobFilter="part-*.tsv")
    head = None
    for n in names:
        same = rows[f"`{n}`"].eqNullSafe(n)
        head = same if head is None else head & same
    return rows.where(~(head & F.input_file_name().endswith(f"part-{0:010d}.tsv")))
