"""mzML: written by many tasks, read again by the text reader and by the data source, its offsets, partitions and pushed filters."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.sources import mzml, runs

SCHEMA = runs.SPECTRA


def _spectra(n=60, seed=1):
    r = random.Random(seed)
    rows = [(f"scan={i}", 1 + i % 2, r.choice([i / 4, i / 4, 3.0]), None if i % 2 == 0 else 400.0 + i / 7, [(100 + r.random() * 900, r.random() * 1e6) for _ in range(r.randint(0, 30))]) for i in range(n)]
    return [*rows, ('a "b" <c> & d\n', 1, None, None, None), ("é", None, 2.5, 1e-7, [])]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mz") / "run.mzML")
    mzml.write_mzml(spark.createDataFrame(_spectra(), SCHEMA).repartition(5), path, run='r "1"')
    return path


def _ordered(rows):
    return sorted(map(repr, rows))


def test_what_is_written_is_read_again(spark, written):
    want = _ordered([(i.replace("\n", " "), level, rt, m, p or []) for i, level, rt, m, p in _spectra()])
    of = lambda df: _ordered([(r.id, r.ms_level, r.rt, r.precursor_mz, [(p.mz, p.intensity) for p in r.peaks]) for r in df.collect()])
    assert of(runs.read_mzml(spark, written)) == want
    assert of(mzml.read_indexed(spark, written, 500)) == want


def test_offsets_point_to_spectra_in_order(written):
    with open(written, "rb") as f:
        data = f.read()
    at = int(re.search(rb"<indexListOffset>(\d+)<", data)[1])
    assert data[at:].startswith(b"<indexList ")
    refs = re.findall(rb'<offset idRef="([^"]*)">(\d+)</offset>', data[at:])
    assert len(refs) == 62 == int(re.search(rb'<spectrumList count="(\d+)"', data)[1])
    for n, (ref, offset) in enumerate(refs):
        assert data[int(offset) :].startswith(b'<spectrum index="%d" id=' % n)
        assert re.match(rb'<spectrum index="\d+" id="([^"]*)"', data[int(offset) :])[1] == ref
    assert mzml.read_index(written) == [int(o) for _, o in refs]
    import xml.dom.minidom

    xml.dom.minidom.parseString(data)


def test_partitions_come_from_the_index(spark, written):
    few, many = mzml.read_indexed(spark, written, 1 << 30), mzml.read_indexed(spark, written, 1)
    assert few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 62
    counts = [len(x) for x in many.rdd.glom().collect()]
    assert counts == [1] * 62


def test_filters_hold_before_peaks_are_decoded(spark, written, monkeypatch):
    df = mzml.read_indexed(spark, written)
    got = df.where("ms_level = 2 and rt > 3 and rt <= 9").select("id", "rt", F.size("peaks").alias("n"))
    want = {i for i, level, rt, *_ in _spectra() if level == 2 and rt is not None and 3 < rt <= 9}
    assert {r.id for r in got.collect()} == want
    # The same in one process: peaks of other spectra are never touched.
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual, StringStartsWith

    reader = mzml.MzmlReader(written, 1 << 30)
    other = StringStartsWith(("id",), "scan")
    assert list(reader.pushFilters([EqualTo(("ms_level",), 2), GreaterThan(("rt",), 3.0), other, LessThanOrEqual(("rt",), 9.0)])) == [other]
    decoded = []
    monkeypatch.setattr(mzml, "spectrum_peaks", lambda x: decoded.append(x) or [])
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert {r[0] for r in rows} == want and len(decoded) == len(want)


def test_windows_plain_arrays_and_refusals(spark, tmp_path):
    path = str(tmp_path / "part.mzML")
    mzml.write_mzml(spark.createDataFrame(_spectra(), SCHEMA), path, compress=False, start=2.0, end=4.0)
    rows = runs.read_mzml(spark, path).collect()
    assert {r.id for r in rows} == {i for i, _, rt, *_ in _spectra() if rt is not None and 2 < rt < 4}
    assert b"MS:1000574" not in open(path, "rb").read()
    with pytest.raises(FileExistsError):
        mzml.write_mzml(spark.createDataFrame(_spectra(3), SCHEMA), path)
    none = str(tmp_path / "none.mzML")
    mzml.write_mzml(spark.createDataFrame([], SCHEMA), none)
    assert runs.read_mzml(spark, none).count() == 0 and mzml.read_indexed(spark, none).count() == 0


def test_a_document_without_an_index_is_one_partition(spark, written, tmp_path):
    with open(written) as f:
        bare = re.sub(r"<indexList .*", "</indexedmzML>", f.read(), flags=re.S)
    (tmp_path / "bare.mzML").write_text(bare)
    df = mzml.read_indexed(spark, str(tmp_path / "bare.mzML"), 1)
    assert df.rdd.getNumPartitions() == 1 and df.count() == 62
    assert np.isfinite(df.where("rt is not null").agg(F.max("rt")).first()[0])
