"""mzML with an index: a writer of one document from many tasks, and a Spark data source that reads by the index.

The writer numbers and renders spectra in ranges of their time; a spectrum's byte offset is the length of the head and of the
parts before, summed per part, plus the running length inside its own part. The index is written by tasks as well, so
that no task and not the driver holds a document. The source cuts a file at offsets of its index, and looks at a spectrum's
level and time before it decodes any peak.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..operators.lineage import cut
from .runs import INTENSITY_ARRAY, ION_MZ, MS_LEVEL, MZ_ARRAY, SCAN_START, SPECTRA, ZLIB, spectrum_head, spectrum_peaks

#: Terms that a writer needs besides.
NO_COMPRESSION, FLOAT_64, MINUTES = "MS:1000576", "MS:1000523", "UO:0000031"
HEAD = """<?xml version="1.0" encoding="utf-8"?>
<indexedmzML xmlns="http://psi.hupo.org/ms/mzml">
<mzML version="1.1.0">
<cvList count="2"><cv id="MS" fullName="Mass spectrometry ontology" URI="psi-ms.obo"/><cv id="UO" fullName="Unit Ontology" URI="unit.obo"/></cvList>
<fileDescription><fileContent><cvParam cvRef="MS" accession="MS:1000580" name="MSn spectrum"/></fileContent></fileDescription>
<softwareList count="1"><software id="writer" version="1"/></softwareList>
<instrumentConfigurationList count="1"><instrumentConfiguration id="instrument"/></instrumentConfigurationList>
<dataProcessingList count="1"><dataProcessing id="written"/></dataProcessingList>
<run id={run} defaultInstrumentConfigurationRef="instrument">
<spectrumList count="{count}" defaultDataProcessingRef="written">
"""
BETWEEN = """</spectrumList>
</run>
</mzML>
<indexList count="1">
<index name="spectrum">
"""
#: The checksum that the format has room for is over the whole document, so only one task could compute it: 0 stands for none.
TAIL = """</index>
</indexList>
<indexListOffset>{at}</indexListOffset>
<fileChecksum>0</fileChecksum>
</indexedmzML>
"""


def _term(accession: str, name: str, value: str = "", unit: str = "") -> str:
    unit = f' unitCvRef="UO" unitAccession="{unit}"' if unit else ""
    return f'<cvParam cvRef="{accession[:2]}" accession="{accession}" name="{name}" value="{value}"{unit}/>'


def _quoted(text: str) -> str:
    """An attribute's value in double quotes, line breaks as spaces."""
    return '"' + re.sub(r"[\r\n]", " ", escape(text, {'"': "&quot;"})) + '"'


def _array(values: np.ndarray, accession: str, name: str, compress: bool) -> str:
    raw = np.asarray(values, "<f8").tobytes()
    text = base64.b64encode(zlib.compress(raw) if compress else raw).decode()
    how = _term(ZLIB, "zlib compression") if compress else _term(NO_COMPRESSION, "no compression")
    return f'<binaryDataArray encodedLength="{len(text)}">{_term(FLOAT_64, "64-bit float")}{how}{_term(accession, name)}<binary>{text}</binary></binaryDataArray>'


def rendered(number: int, spectrum: str, level: int | None, rt: float | None, ion: float | None, mz: np.ndarray, intensity: np.ndarray, compress: bool) -> str:
    """One spectrum element on one line."""
    known = lambda v: v is not None and v == v
    parts = [f'<spectrum index="{number}" id={_quoted(spectrum)} defaultArrayLength="{len(mz)}">']
    if known(level):
        parts.append(_term(MS_LEVEL, "ms level", str(int(level))))
    if known(rt):
        parts.append(f'<scanList count="1"><scan>{_term(SCAN_START, "scan start time", repr(float(rt)), MINUTES)}</scan></scanList>')
    if known(ion):
        parts.append(f'<precursorList count="1"><precursor><selectedIonList count="1"><selectedIon>{_term(ION_MZ, "selected ion m/z", repr(float(ion)))}</selectedIon></selectedIonList></precursor></precursorList>')
    parts.append(f'<binaryDataArrayList count="2">{_array(mz, MZ_ARRAY, "m/z array", compress)}{_array(intensity, INTENSITY_ARRAY, "intensity array", compress)}</binaryDataArrayList></spectrum>')
    return "".join(parts)


def write_mzml(spectra: DataFrame, path: str, run: str = "sample=0", compress: bool = True, start: float | None = None, end: float | None = None) -> None:
    """``spectra`` (id, ms_level, rt in minutes, precursor_mz, peaks) as one indexed document at ``path``, in order of time, then id.

    Only spectra strictly inside (``start``, ``end``) are written, if given. Missing values are left out of their element, missing
    peaks are none, line breaks in ids become spaces. An existing path is an error. The driver handles a number of rows and of bytes
    per part, and joins the parts in the store: by its own concatenation where it has one (then no byte moves), else by copying
    them in blocks.
    """
    spark = spectra.sparkSession
    if start is not None:
        spectra = spectra.where(F.col("rt") > start)
    if end is not None:
        spectra = spectra.where(F.col("rt") < end)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("rt").asc_nulls_last(), F.col("id")]
    rows = cut(spectra.select("id", "ms_level", "rt", "precursor_mz", "peaks").repartitionByRange(parts, *order).sortWithinPartitions(*order))
    place = {"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    rows = rows.withColumns(place)
    first, total = _sums(rows, F.lit(1))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                peaks = r.peaks if r.peaks is not None else []
                mz, it = (np.array([p[k] for p in peaks], float) for k in ("mz", "intensity"))
                out.append(rendered(first[r.part] + r.row, r.id, r.ms_level, r.rt, r.precursor_mz, mz, it, compress))
            yield pd.DataFrame({"part": b["part"], "row": b["row"], "id": b["id"], "xml": out})

    xml = cut(rows.mapInPandas(render, "part int, row bigint, id string, xml string"))
    head = HEAD.format(run=_quoted(run), count=total)
    size = F.octet_length("xml").cast("bigint") + 1  # and a line feed
    before, length = _sums(xml, size)
    base = len(head.encode())
    own = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    at = (F.lit(base) + F.try_element_at(starts, F.col("part")) + F.coalesce(F.sum(size).over(own), F.lit(0))).cast("string")
    ref = F.replace(F.replace(F.replace(F.replace("id", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    ref = F.regexp_replace(ref, "[\r\n]", " ")
    index = xml.withColumn("line", F.concat(F.lit('<offset idRef="'), ref, F.lit('">'), at, F.lit("</offset>"))).repartitionByRange(parts, "part", "row").sortWithinPartitions("part", "row")
    folder = f"{path}.parts"
    xml.select("xml").write.text(f"{folder}/spectra")
    index.select("line").write.text(f"{folder}/index")
    where = base + length + len(BETWEEN.encode()) - len(BETWEEN[BETWEEN.index("<indexList ") :].encode())
    _joined(spark, folder, [head, "spectra", BETWEEN, "index", TAIL.format(at=where)], path)


def _sums(rows: DataFrame, value) -> tuple[dict[int, int], int]:
    """({part: sum over the parts before}, sum over all)."""
    total, out = 0, {}
    for r in sorted(rows.groupBy("part").agg(F.sum(value).alias("n")).collect()):  # a row per part
        out[r["part"]], total = total, total + r["n"]
    return out, total


def _joined(spark: SparkSession, folder: str, pieces: list[str], path: str) -> None:
    """One file of texts and of the files of written folders, in order; the folder goes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path
    target, top = to(path), to(folder)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    files = []
    for k, piece in enumerate(pieces):
        if piece in ("spectra", "index"):
            files += sorted((s.getPath() for s in fs.listStatus(to(f"{folder}/{piece}")) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
        else:
            out = fs.create(to(f"{folder}/text-{k}"), True)
            out.write(bytearray(piece.encode()))
            out.close()
            files.append(to(f"{folder}/text-{k}"))
    try:
        many = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(files) - 1)
        for k, f in enumerate(files[1:]):
            many[k] = f
        fs.concat(files[0], many)
        fs.rename(files[0], target)
    except Exception:  # a store without concatenation
        half = to(f"{folder}/whole")
        out = fs.create(half, True)
        for f in files:
            source = fs.open(f)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
        out.close()
        fs.rename(half, target)
    fs.delete(top, True)


def _open(path: str):
    """(file, size) of a path of any store that pyarrow knows."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inside), store.get_file_info(inside).size


def read_index(path: str) -> list[int]:
    """Byte offsets of the spectra of an indexed document, rising; none where it has no index."""
    f, size = _open(path)
    with f:
        tail = f.read_at(min(size, 4096), max(0, size - 4096))
        if not (m := re.search(rb"<indexListOffset>(\d+)</indexListOffset>", tail)) or not 0 < int(m[1]) < size:
            return []
        text = f.read_at(size - int(m[1]), int(m[1]))
        spectra = re.search(rb'<index name="spectrum">(.*?)</index>', text, re.S)
        return sorted(int(x) for x in re.findall(rb"<offset [^>]*>(\d+)</offset>", spectra[1])) if spectra else []


class Piece(InputPartition):
    """Bytes [start, end) of a file, whole spectra."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MzmlReader(DataSourceReader):
    """Pieces of a file between offsets of its index; filters on level and time hold before peaks are decoded."""

    def __init__(self, path: str, piece_bytes: int):
        self.path, self.piece_bytes, self.tests = path, piece_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) in (("ms_level",), ("rt",)) and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        _, size = _open(self.path)
        cuts = read_index(self.path)
        if not cuts:
            return [Piece(self.path, 0, size)]
        out, start = [], cuts[0]
        for at in cuts[1:]:
            if at - start >= self.piece_bytes:
                out.append(Piece(self.path, start, at))
                start = at
        return [*out, Piece(self.path, start, size)]

    def holds(self, level: int | None, rt: float | None) -> bool:
        for f in self.tests:
            v = level if f.attribute == ("ms_level",) else rt
            if v is None:
                return False
            ok = {EqualTo: lambda: v == f.value, In: lambda: v in f.value, GreaterThan: lambda: v > f.value, GreaterThanOrEqual: lambda: v >= f.value, LessThan: lambda: v < f.value, LessThanOrEqual: lambda: v <= f.value, IsNotNull: lambda: True}[type(f)]  # noqa: B023
            if not ok():
                return False
        return True

    def read(self, partition: Piece) -> Iterator[tuple]:
        f, _ = _open(partition.path)
        with f:
            f.seek(partition.start)
            rest, left = b"", partition.end - partition.start
            while left > 0 or rest:
                block = f.read(min(left, 4 << 20)) if left > 0 else b""
                left -= len(block)
                *whole, rest = (rest + block).split(b"</spectrum>")
                for x in whole:
                    at = x.find(b"<spectrum ")
                    if at < 0:
                        continue
                    xml = x[at + len(b"<spectrum ") :].decode()
                    head = spectrum_head(xml)
                    if head is not None and self.holds(head[1], head[2]):
                        yield (*head, [(p["mz"], p["intensity"]) for p in spectrum_peaks(xml)])
                if not block:
                    return


class MzmlSource(DataSource):
    """``spark.read.format("mzml").load(path)``: option ``piece_bytes``, about the bytes of a partition (16 MB)."""

    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return SPECTRA

    def reader(self, schema) -> MzmlReader:
        return MzmlReader(self.options["path"], int(self.options.get("piece_bytes", 16 << 20)))


def read_indexed(spark: SparkSession, path: str, piece_bytes: int = 16 << 20) -> DataFrame:
    """id, ms_level, rt, precursor_mz, peaks of one document, in partitions by its index; filters on level and time are pushed to it.

    A document without an index is one partition. The path is opened by pyarrow's file systems, on the driver and the executors.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MzmlSource)
    return spark.read.format("mzml").option("piece_bytes", piece_bytes).load(path)
