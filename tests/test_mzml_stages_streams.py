"""Split mzML files, resumable stages, groups of a stream that end, overlaps in tolerance."""

from __future__ import annotations

import base64
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import stages
from tidewell.operators.acquisition import n_overlapping
from tidewell.sources import mzml, spectra
from tidewell.streaming import groups, windows


def document(n, seed, indexed=True, wrong_index=False):
    """The bytes of an mzML file of n spectra, some of them long, with or without an index."""
    rng = np.random.default_rng(seed)
    out, offsets = bytearray(b'<?xml version="1.0"?>\n<indexedmzML xmlns="http://psi.hupo.org/ms/mzml"><mzML><run><spectrumList count="%d">\n' % n), []
    for i in range(n):
        peaks = int(rng.integers(0, 40 if i % 9 else 3000))
        arrays = ""
        for values, kind in ((np.sort(rng.uniform(100, 900, peaks)), "MS:1000514"), (rng.uniform(0, 1e4, peaks), "MS:1000515")):
            packed = i % 2 == 0
            raw = values.astype("<f8").tobytes()
            text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
            arrays += f'<binaryDataArray><cvParam accession="MS:1000523"/>{"<cvParam accession=" + chr(34) + "MS:1000574" + chr(34) + "/>" if packed else ""}<cvParam accession="{kind}"/><binary>{text}</binary></binaryDataArray>'
        level = 1 if i % 5 == 0 else 2
        target = '<precursor><cvParam accession="MS:1000827" value="500.5"/></precursor>' if level == 2 else ""
        offsets.append(len(out))
        out += f'<spectrum index="{i}" id="scan={i}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000016" value="{i * 0.1}" unitAccession="UO:0000031"/>{target}{arrays}</spectrum>\n'.encode()
    out += b"</spectrumList></run></mzML>\n"
    if indexed:
        at = len(out)
        places = [o + 10**9 for o in offsets] if wrong_index else offsets
        out += b'<indexList count="1"><index name="spectrum">' + b"".join(b'<offset idRef="scan=%d">%d</offset>\n' % x for x in enumerate(places)) + b'</index></indexList>\n<indexListOffset>%d</indexListOffset>' % at
    return bytes(out + b"</indexedmzML>")


def plain(rows):
    return sorted((r.file_name, r.scan, r.ms_level, round(r.rt, 6), r.iso_low, tuple(r.mzs), tuple(r.intensities)) for r in rows)


def test_split_files_equal_whole_ones(spark, tmp_path):
    for name, options in (("a", {}), ("b", {"indexed": False}), ("c", {"wrong_index": True})):
        (tmp_path / f"{name}.mzML").write_bytes(document(60, ord(name), **options))
    (tmp_path / "empty.mzML").write_bytes(document(0, 1))
    (tmp_path / "other.txt").write_text("<spectrum index='1'></spectrum>")
    want = plain(spectra.read_mzml(spark, str(tmp_path)).collect())
    assert len(want) > 100
    spark.dataSource.register(mzml.MzmlSource)
    for size in (997, 20_000, 1 << 24):
        df = spark.read.format("mzml").option("splitBytes", size).load(str(tmp_path))
        assert plain(df.collect()) == want
        tasks = df.rdd.getNumPartitions()
        assert tasks == 4 if size == 1 << 24 else tasks > 20
    one = spark.read.format("mzml").option("splitBytes", 5000).load(f"file://{tmp_path}/a.mzML").filter("ms_level = 2")
    assert plain(one.collect()) == [r for r in want if r[0] == "a" and r[2] == 2]
    with pytest.raises(Exception, match="absent"):
        spark.read.format("mzml").load(str(tmp_path / "absent")).collect()


def test_splits_cover_the_file(tmp_path, monkeypatch):
    """Any chunk size gives each spectrum once, in the split in which it begins."""
    path = tmp_path / "x.mzML"
    path.write_bytes(document(30, 5))
    size = path.stat().st_size
    for chunk in (64, 1000, 1 << 20):
        monkeypatch.setattr(mzml, "CHUNK", chunk)
        whole = list(mzml.elements(str(path), 0, size))
        assert len(whole) == 30 and all(x.startswith(b"<spectrum ") and x.endswith(b"</spectrum>") for x in whole)
        found = mzml.splits(str(path), size, 3000)
        assert found[0].start == 0 and found[-1].stop == size and all(a.stop == b.start for a, b in zip(found, found[1:]))
        assert [x for s in found for x in mzml.elements(str(path), s.start, s.stop)] == whole
        assert [x for s in range(0, size, 777) for x in mzml.elements(str(path), s, min(size, s + 777))] == whole


def test_a_stopped_job_goes_on(spark, tmp_path):
    source = tmp_path / "numbers"
    spark.range(10).write.parquet(str(source))
    calls, stop = [], {"at": "double"}

    def counted(name, work):
        def run(spark, inputs, settings):
            calls.append(name)
            if stop["at"] == name:
                raise RuntimeError("stopped")
            return work(spark, inputs, settings)

        return run

    def job(factor=2, least=5):
        return [
            stages.Stage("read", counted("read", lambda s, i, o: s.read.parquet(str(source))), reads=(str(source),)),
            stages.Stage("double", counted("double", lambda s, i, o: i["read"].select((F.col("id") * o["factor"]).alias("id"))), ("read",), settings={"factor": factor}),
            stages.Stage("large", counted("large", lambda s, i, o: i["double"].filter(F.col("id") >= o["least"])), ("double",), settings={"least": least}),
            stages.Stage("count", counted("count", lambda s, i, o: i["read"].groupBy().count()), ("read",)),
        ]

    folder = str(tmp_path / "job")
    with pytest.raises(RuntimeError):
        stages.run_stages(spark, job(), folder)
    assert calls == ["read", "double"]
    stop["at"] = None
    tables, ran = stages.run_stages(spark, job(), folder)
    assert ran == ["double", "large", "count"] and calls == ["read", "double", "double", "large", "count"]
    assert sorted(r.id for r in tables["large"].collect()) == [6, 8, 10, 12, 14, 16, 18]
    assert stages.run_stages(spark, job(), folder)[1] == []
    assert stages.run_stages(spark, job(least=9), folder)[1] == ["large"]
    assert stages.run_stages(spark, job(factor=3, least=9), folder)[1] == ["double", "large"]
    assert stages.run_stages(spark, job(factor=3, least=9), folder, version="2")[1] == ["read", "double", "large", "count"]
    spark.range(3).write.mode("append").parquet(str(source))
    assert stages.run_stages(spark, job(factor=3, least=9), folder, version="2")[1] == ["read", "double", "large", "count"]
    (tmp_path / "job" / ".large.json.crc").unlink()
    (tmp_path / "job" / "large.json").write_text(json.dumps({"key": "other", "path": "gone"}))
    tables, ran = stages.run_stages(spark, job(factor=3, least=9), folder, version="2")
    assert ran == ["large"] and tables["count"].first()[0] == 13
    with pytest.raises(ValueError, match="no stage"):
        stages.run_stages(spark, job()[1:], folder)


def test_groups_end(spark, tmp_path):
    """Complete groups once, incomplete ones when nothing comes any more, repeats and late items ignored."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    shape = "run long, item long, value double, parts int, at timestamp"

    def feed(name, rows):
        spark.createDataFrame([(r, i, float(v), p, f"2024-01-01 00:{m:02d}:00") for r, i, v, p, m in rows], "run long, item long, value double, parts int, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(shape).parquet(str(source))
        found = groups.collected_groups(stream, ["run"], "item", "value", "parts", "at", "1 minute", 300)
        windows.run_once(found, out, str(tmp_path / "state"))
        return sorted((r.run, r.n, r.total, r.complete) for r in spark.read.schema("run long, n long, total double, complete boolean").parquet(out).collect())

    assert feed("1", [(1, 0, 1, 2, 0), (1, 0, 9, 2, 0), (2, 0, 5, 3, 0), (1, 1, 2, 2, 1)]) == [(1, 2, 3.0, True)]
    assert feed("2", [(1, 1, 7, 2, 2), (2, 1, 6, 3, 2), (3, 0, 1, 1, 3)]) == [(1, 2, 3.0, True), (3, 1, 1.0, True)]
    got = feed("3", [(9, 0, 1, 2, 30)])
    got = feed("4", [(9, 0, 1, 2, 31)])
    assert got == [(1, 2, 3.0, True), (2, 2, 11.0, False), (3, 1, 1.0, True)]


def test_overlap(spark):
    rnd = random.Random(2)
    rows = [([rnd.uniform(100, 120) for _ in range(rnd.randrange(7))], [rnd.uniform(100, 120) for _ in range(rnd.randrange(7))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for tolerance, unit in ((0.5, "absolute"), (3000.0, "ppm")):
        got = [r.n for r in df.select(n_overlapping(F.col("a"), F.col("b"), tolerance, unit).alias("n")).collect()]
        assert got == [sum(any(abs(x - y) <= (x * tolerance / 1e6 if unit == "ppm" else tolerance) for y in b) for x in a) for a, b in rows]
