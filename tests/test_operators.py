"""Kernels and operators without SQL, against small cases worked out by hand."""

from __future__ import annotations

import base64
import math
import sqlite3
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import kernels as K
from tidewell.operators import fdr, grouping, local_fit, models, peaks, search
from tidewell.operators.components import connected_components
from tidewell.sources import libraries, sinks, spectra
from tidewell.streaming import windows


def gauss(n, center, sigma):
    return np.exp(-((np.arange(n) - center) ** 2) / 2 / sigma**2)


def test_consensus_peaks():
    one = gauss(60, 20, 3)
    assert [p[0] for p in K.consensus_peaks(np.array([100 * one, 50 * one, 70 * one]), 0.01)][:1] == [20]
    two = gauss(60, 15, 3) + gauss(60, 45, 3)
    assert sorted(p[0] for p in K.consensus_peaks(np.array([100 * two, 40 * two]), 0.01)) == [15, 45]
    odd = np.array([100 * one, 50 * one, 1000 * gauss(60, 45, 3)])
    assert [p[0] for p in K.consensus_peaks(odd, 0.01)][0] == 20
    assert not K.consensus_peaks(np.zeros((3, 60)), 0.01) and not K.consensus_peaks(np.array([one]), 0.01) and not K.consensus_peaks(np.ones((3, 4)), 0.01)


def test_local_lines():
    """A point without weight counts for nothing; points that stand for several count so often."""
    x = np.linspace(0, 10, 101)
    y = 2 * x + 1
    y[50] = 500
    weights = np.where(np.arange(101) == 50, 0.0, 1.0)
    fitted = K.local_lines(x, y, np.ones(len(x)), weights, 0.3)
    assert np.abs(fitted - (2 * x + 1)).max() < 1e-6


def test_polish_machine_chances():
    overall, rows, cols, rest = K.median_polish(np.outer([1, 2, 4], [1, 3, 9, 3, 1.0]))
    assert np.abs(rest).max() < 1e-9 and np.exp(overall + rows[2] + cols[2]) == pytest.approx(36)
    x = np.vstack([np.random.default_rng(1).normal(2, 0.5, (40, 2)), np.random.default_rng(2).normal(-2, 0.5, (40, 2))])
    sign = np.repeat([1.0, -1.0], 40)
    w = K.linear_machine(x, sign, 1.0, 1)
    assert (np.sign(x @ w[:2] + w[2]) == sign).all()
    assert ((x @ K.discriminant(x, sign > 0)) > 0).tolist() == (sign > 0).tolist()
    assert K.discriminant(x, np.ones(80, bool)) is None
    p = K.error_chances(np.linspace(-4, 4, 50), x[:, 0], sign < 0)
    assert (np.diff(p) <= 1e-12).all() and p[0] > 0.9 and p[-1] < 0.1
    assert K.falling(np.array([1, 0.5, 0.6, 0.2])).tolist() == pytest.approx([1, 0.55, 0.55, 0.2])


def test_cross_correlation():
    mz, y = np.array([300.0, 400.0, 500.0]), np.array([100.0, 80.0, 60.0])
    spectrum = K.binned_correlation_spectrum(mz, y)
    assert spectrum.dtype == np.float32
    assert K.cross_correlation(spectrum, mz) > K.cross_correlation(spectrum, mz + 5) and K.cross_correlation(spectrum, np.array([9999.0])) == 0


def test_competition_rules(spark):
    rows = [(1, False, 5.0), (1, True, 4.0), (2, False, 3.0), (2, True, 3.0), (3, True, 9.0), (4, False, 1.0)]
    got = {r.base: (r.score, r.decoy) for r in fdr.compete(spark.createDataFrame(rows, "base long, decoy boolean, score double"), ["base"]).collect()}
    assert got == {1: (5.0, False), 2: (3.0, True), 3: (9.0, True), 4: (1.0, False)}


def test_hand_table(spark):
    ranked = spark.createDataFrame([(i, d, 10.0 - i) for i, d in enumerate([False, False, True, False, True])], "base long, decoy boolean, score double")
    q = lambda kind: [r.q for r in fdr.q_values(ranked, ["base"], kind).orderBy("base").collect()]
    assert q(fdr.REPORTED) == pytest.approx([0.5, 0.5, 2 / 3, 2 / 3, 1])
    assert q(fdr.TRAINING) == pytest.approx([0, 0, 1 / 3, 1 / 3, 2 / 3])


def test_razor_and_components(spark):
    groups = spark.createDataFrame([(1, ["a", "b", "s"]), (2, ["s", "c"]), (3, ["x"])], "group_id long, members array<string>")
    got = {r.group_id: r.members for r in grouping.razor(groups).collect()}
    assert got == {1: ["a", "b", "s"], 2: ["c"], 3: ["x"]}
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (None, 3), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(path).collect()}
    assert all(roots[i] == 0 for i in range(201)) and roots[501] == 500 and len(roots) == 203
    assert connected_components(path.limit(0)).count() == 0


def test_model_separates(spark):
    rng = np.random.default_rng(0)
    rows = [(i, d, f"p{i}", float(rng.normal(0 if d or i % 2 else 4, 1)), float(rng.normal(0 if d or i % 2 else 3, 1))) for i in range(400) for d in (False, True)]
    out = models.experiment(spark.createDataFrame(rows, "base long, decoy boolean, peptide string, f1 double, f2 double"), ["f1", "f2"]).collect()
    assert len(out) == 400
    good = [r for r in out if not r.decoy and r.q <= 0.05]
    assert len(good) > 150 and sum(r.base % 2 == 0 for r in good) > 0.9 * len(good)
    assert sorted(r.pep for r in good)[len(good) // 2] < 0.2


def test_curves(spark):
    points = spark.createDataFrame([("r", float(x), 2.0 * x + 1) for x in range(100)], "run string, x double, y double")
    curves = local_fit.fit_curves(points, ["run"], "x", "y")
    asked = spark.createDataFrame([("r", -5.0), ("r", 50.5), ("r", 200.0)], "run string, x double")
    assert [r.y for r in local_fit.apply_curves(asked, curves, ["run"], "x", "y").orderBy("x").collect()] == pytest.approx([-9, 102, 401])
    assert [r.x2 for r in local_fit.apply_curves(asked.withColumn("x", F.col("x") * 2 + 1), curves, ["run"], "x", "x2", inverse=True).orderBy("x").collect()] == pytest.approx([-5, 50.5, 200])


def gaussian_run(n=40, center=10.0):
    scans = []
    for i in range(n):
        rt = 8 + 4 * i / (n - 1)
        base = 10 + 1000 * math.exp(-((rt - center) ** 2) / 2 / 0.2**2)
        scans.append(("run1", i, rt, 487.5, 512.5, [300.0, 400.0, 500.0], [base, base * 0.8, base * 0.6]))
    return scans


def test_search_finds_the_peak(spark):
    shape = "file_name string, scan int, rt double, iso_low double, iso_high double, mzs array<double>, intensities array<double>"
    runs = spark.createDataFrame(gaussian_run(), shape)
    fragments = [(300.0, 100.0), (400.0, 80.0), (500.0, 60.0)]
    entries = spark.createDataFrame([(1, 500.0, 10.1, fragments, False), (2, 500.0, 10.1, [(310.0, 1.0), (411.0, 1.0)], True), (3, 700.0, 10.0, fragments, False), (4, 512.5, 10.0, fragments, False)], "entry_id long, precursor_mz double, rt double, fragments array<struct<mz:double,intensity:double>>, decoy boolean")
    got = search.search(entries, runs).collect()
    assert [r.entry_id for r in got] == [1]
    assert abs(got[0].apex_rt - 10.0) < 0.1 and got[0].similarity > 0.99 and got[0].n_fragments == 3
    assert search.search(entries.limit(0), runs).count() == 0


def test_detect_in_groups(spark):
    rows = [(u, f, i, float(100 * v)) for u, c in (("a", 20), ("b", 35)) for f in range(3) for i, v in enumerate(gauss(60, c, 3))]
    got = peaks.detect(spark.createDataFrame(rows, "u string, f int, i int, y double"), ["u"], "f", "i", "y").filter("rank = 1").collect()
    assert {r.u: r.apex for r in got} == {"a": 20, "b": 35}


def test_text_library(spark, tmp_path):
    path = tmp_path / "lib.tsv"
    head = "precursormz\tPrecursorCharge\tModifiedPeptide\tFragmentMz\tRelativeIntensity\tProteinId\n"
    path.write_text(head + "".join(f"500.5\t2\tPEPK\t{m}\t{i}\tP1; P2\n" for m, i in ((300, 5), (400, 9), (500, 1))) + "600\t2\tSHORT\t300\t1\tP3\n")
    got = libraries.entries(libraries.fragment_rows(spark, str(path))).collect()
    assert [(r.modified_sequence, r.proteins, [f.mz for f in r.fragments]) for r in got] == [("PEPK", ["P1", "P2"], [400.0, 300.0, 500.0])]
    with pytest.raises(ValueError, match="fragment_mz"):
        libraries.resolve_headers(["PrecursorMz", "Charge", "ModifiedPeptide", "Intensity"])


def test_sqlite_library(spark, tmp_path):
    path = str(tmp_path / "lib.blib")
    with sqlite3.connect(path) as con:
        con.executescript("CREATE TABLE RefSpectra (id INTEGER, peptideSeq TEXT, peptideModSeq TEXT, precursorMZ REAL, precursorCharge INTEGER, retentionTime REAL, numPeaks INTEGER); CREATE TABLE RefSpectraPeaks (RefSpectraID INTEGER, peakMZ BLOB, peakIntensity BLOB); CREATE TABLE Proteins (id INTEGER, accession TEXT); CREATE TABLE RefSpectraProteins (RefSpectraId INTEGER, ProteinId INTEGER);")
        con.execute("INSERT INTO RefSpectra VALUES (1, 'PEP', 'PEP', 500.0, 2, 10.0, 40), (2, 'TID', 'TID', 400.0, 3, 11.0, 0)")
        con.execute("INSERT INTO RefSpectraPeaks VALUES (1, ?, ?)", (libraries.pack([300.0] * 40, "d"), libraries.pack([2.0] * 39 + [4.0], "f")))
        con.execute("INSERT INTO Proteins VALUES (7, 'P7')")
        con.execute("INSERT INTO RefSpectraProteins VALUES (1, 7)")
    got = {r.id: r for r in libraries.spectral_library(spark, path).collect()}
    assert got[1].mzs == [300.0] * 40 and got[1].intensities == [0.5] * 39 + [1.0] and got[1].proteins == ["P7"]
    assert got[2].mzs == [] and got[2].proteins == []


def test_mzml(spark, tmp_path):
    def array(values, kind, packed):
        raw = np.array(values, "<f8").tobytes()
        text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        return f'<binaryDataArray><cvParam accession="MS:1000523"/>{"<cvParam accession=" + chr(34) + "MS:1000574" + chr(34) + "/>" if packed else ""}<cvParam accession="{kind}"/><binary>{text}</binary></binaryDataArray>'

    def one(level, seconds, target, values):
        ion = f'<precursor><isolationWindow><cvParam accession="MS:1000827" value="{target}"/></isolationWindow></precursor>' if target else ""
        return f'<spectrum><cvParam accession="MS:1000511" value="{level}"/><scan><cvParam accession="MS:1000016" value="{seconds}" unitAccession="UO:0000010"/></scan>{ion}<binaryDataArrayList>{array(values, "MS:1000514", True)}{array([1.0] * len(values), "MS:1000515", False)}</binaryDataArrayList></spectrum>'

    (tmp_path / "a.mzML").write_text(f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>{one(1, 60, None, [500.0])}{one(2, 90, 600.0, [400.0, 300.0])}{one(2, 120, None, [1.0])}</spectrumList></run></mzML>')
    rows = spectra.read_mzml(spark, str(tmp_path)).orderBy("scan").collect()
    assert [(r.file_name, r.scan, r.ms_level, r.rt) for r in rows] == [("a", 0, 1, 1.0), ("a", 1, 2, 1.5)]
    assert (rows[1].iso_low, rows[1].iso_high, rows[1].mzs) == (587.5, 612.5, [300.0, 400.0])
    assert spectra.fragment_spectra(spectra.read_mzml(spark, str(tmp_path))).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("f", "PEPK", 2, 7, False, 1.23456, 0.5), ("g", "PEPR", 3, 8, True, 2.0, 0.1)], "file_name string, modified_sequence string, charge int, scan int, decoy boolean, score double, q double")
    sinks.write_scores(rows, str(tmp_path / "scores"), version="1")
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 2
    assert sinks.facts_match(spark, str(tmp_path / "scores"), version="1") and not sinks.facts_match(spark, str(tmp_path / "scores"), version="2")
    assert sinks.report(rows, {"score": 2}).first()["score"] == "1.23"
    pin = sinks.model_input(rows, ["score"]).collect()
    assert [(r.label, r.charge_2, r.charge_3, r.peptide) for r in pin] == [(1, 1, 0, "-.PEPK.-"), (-1, 0, 1, "-.PEPR.-")]
    entries = spark.createDataFrame([(1, "PEPK", 2, 500.0, 10.0, 9.0, 11.0, ["P2", "P1"], [300.0, 400.0], [1.0, 0.5])], "entry_id long, modified_sequence string, charge int, precursor_mz double, rt double, start double, end double, proteins array<string>, mzs array<double>, intensities array<double>")
    tables = sinks.library_tables(entries)
    assert tables["modifications"].count() == 0
    noted = entries.select(F.explode(F.array(*map(F.lit, ["PEPC[+57.021464]TM[+15.9949]K", "[42.010565]AC(UniMod:4)K", "PEPK"]))).alias("modified_sequence"), *[c for c in entries.columns if c != "modified_sequence"])
    got = {(r.position, round(r.mass, 6)) for r in sinks.library_tables(noted)["modifications"].collect()}
    assert got == {(4, 57.021464), (6, 15.9949), (1, 42.010565), (2, 57.0215)}  # ids become masses of four decimals
    assert tables["peaks"].count() == 2 and {(r.accession, r.protein_id) for r in tables["proteins"].collect()} == {("P1", 0), ("P2", 1)}


def test_streams(spark, tmp_path):
    schema = "k string, item long, value double, expected int, ts timestamp"
    rows = [("a", 1, 1.0, 2, 0), ("b", 1, 5.0, 3, 30), ("a", 1, 1.0, 2, 40), ("a", 2, 2.0, 2, 90), ("b", 2, 1.0, 3, 95), ("z", 1, 0.0, 9, 4000)]
    from datetime import datetime, timedelta

    data = [(k, i, v, n, datetime(2024, 1, 1) + timedelta(seconds=s)) for k, i, v, n, s in rows]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    windows.run_once(windows.completed_groups(stream(), ["k"], "item", "value", "expected"), str(tmp_path / "done"), str(tmp_path / "c1"))
    assert [(r.k, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "done")).collect()] == [("a", 2, 3.0)]
    windows.run_once(windows.windowed_totals(stream(), ["k"], "ts", "value", "1 minute", "1 minute"), str(tmp_path / "totals"), str(tmp_path / "c2"))
    got = {(r.k, r.start.minute): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "totals")).collect()}
    assert got == {("a", 0): (2, 2.0), ("b", 0): (1, 5.0), ("a", 1): (1, 2.0), ("b", 1): (1, 1.0)}


def test_isotopes_and_double_counts(spark):
    from tidewell.operators import acquisition as A

    atoms = spark.createDataFrame([(50, 80, 14, 16, 1)], "c int, h int, n int, o int, s int").select(F.struct("c", "h", "n", "o", "s").alias("a"))
    got = atoms.select(A.isotope_distribution(F.col("a")).alias("d")).first().d
    polynomial = np.ones(1)
    for n, shares in ((50, [1 - 0.0107, 0.0107]), (80, [1 - 0.000115, 0.000115]), (14, [1 - 0.00364, 0.00364]), (16, [1 - 0.00243, 0.00038, 0.00205]), (1, [0.95, 0.0075, 0.0425])):
        for _ in range(n):
            polynomial = np.convolve(polynomial, shares)[:5]
    assert got == pytest.approx(list(polynomial / polynomial.sum()), rel=1e-9)
    rows = [(1, "w", 10.0, [1, 2, 3], 5.0), (2, "w", 10.4, [1, 2, 9], 4.0), (3, "w", 10.8, [1, 9, 2], 3.0), (4, "w", 10.2, [7, 8], 1.0), (5, "v", 10.0, [1, 2, 3], 1.0)]
    df = spark.createDataFrame(rows, "id long, win string, at double, f array<int>, score double")
    out = A.without_double_counts(df, ["win"], "id", "at", "f", "score", 0.5)
    assert sorted(r.id for r in out.collect()) == [1, 3, 4, 5]


def test_named_losses(spark):
    from tidewell.functions.sequences import NEUTRAL_LOSS, neutral_loss

    names = ["h2o", " Water", "NH3", "ammonia", "PHOSPHO", "H3PO4", "97.5", "", "noloss", "other", None]
    got = [r.x for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(neutral_loss(F.col("n")).alias("x")).collect()]
    assert got == [NEUTRAL_LOSS[x] for x in ("H2O", "H2O", "NH3", "NH3", "H3PO4", "H3PO4")] + [97.5, None, None, None, None]
