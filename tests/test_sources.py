"""Readers and writers of files against what was put into them, and operators over small cases."""

from __future__ import annotations

import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import evidence, local_fit
from tidewell.sources import libraries, sinks


def packed(values, code="d"):
    return struct.pack(f"<{len(values)}{code}", *values)


def test_entry_library(spark, tmp_path):
    path = str(tmp_path / "a.elib")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE entries (PeptideModSeq, PrecursorCharge, PrecursorMz, RTInSeconds, ProteinAccession)")
        con.execute("CREATE TABLE peaks (PeptideModSeq, PrecursorCharge, MassArray, IntensityArray)")
        con.executemany("INSERT INTO entries VALUES (?, ?, ?, ?, ?)", [("PEPK", 2, 500.5, 120.0, "P1"), ("AAK", 3, 300.25, None, None), ("PEPK", 3, 400.0, 60.0, "P2")])
        con.executemany("INSERT INTO peaks VALUES (?, ?, ?, ?)", [("PEPK", 2, packed([100.0, 200.0]), packed([1.0, 2.0])), ("PEPK", 3, packed([100.0, 200.0, 300.0], "f"), packed([1.0, 2.0, 3.0], "f"))])
    got = [tuple(r) for r in libraries.entry_library(spark, path).select("entry_id", "modified_sequence", "charge", "precursor_mz", "rt", "mzs", "intensities", "proteins").orderBy("entry_id").collect()]
    assert got == [(0, "AAK", 3, 300.25, 0.0, [], [], []), (1, "PEPK", 2, 500.5, 2.0, [100.0, 200.0], [1.0, 2.0], ["P1"]), (2, "PEPK", 3, 400.0, 1.0, [100.0, 200.0, 300.0], [1.0, 2.0, 3.0], ["P2"])]


def test_precursors_without_entries(spark, tmp_path):
    path = str(tmp_path / "b.elib")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE peptidetoprotein (PeptideModSeq, PrecursorCharge, PrecursorMz)")
        con.executemany("INSERT INTO peptidetoprotein VALUES (?, ?, ?)", [("PEPK", 2, 500.5), ("PEPK", 2, 500.5), ("AAK", 2, 300.0)])
    got = [(r.entry_id, r.modified_sequence, r.mzs, r.rt) for r in libraries.entry_library(spark, path).orderBy("entry_id").collect()]
    assert got == [(0, "AAK", [], 0.0), (1, "PEPK", [], 0.0)]


def test_external_results(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text("PSMId\tpeptide\tscore\tq-value\tposterior_error_prob\na\tPEP\t2.5\t0.001\t0.0005\nb\tAAA\tx\tnone\t0.2\n\nc\n")
    got = {tuple(r) for r in libraries.external_results(spark, str(path)).collect()}
    assert got == {("a", "PEP", 2.5, 0.001, 0.0005), ("b", "AAA", 0.0, 1.0, 0.2), ("c", "", 0.0, 1.0, 1.0)}


def test_calibration_round_trip(spark, tmp_path):
    points = spark.range(60).select(F.lit("r").alias("run"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + F.col("id") % 3).alias("y"))
    curves = local_fit.fit_curves(points, ["run"], "x", "y")
    sinks.write_calibration(curves, str(tmp_path / "c"), ["run"])
    assert sinks.read_calibration(spark, str(tmp_path / "c"), ["run"]).collect() == curves.select("run", "knots", "fitted", "residuals", "sd", "mad", "n").collect()
    there = local_fit.apply_curves(points, curves, ["run"], "x", "at")
    back = local_fit.apply_curves(there.drop("x"), curves, ["run"], "at", "x", inverse=True).join(points.select("x", "y"), "y")
    assert back.filter("abs(at - y) > 3").count() == 0
    sinks.write_pairs(points.select("x", "y", F.lit(None).cast("int").alias("n")), str(tmp_path / "p"))
    assert (tmp_path / "p").exists() and spark.read.csv(str(tmp_path / "p"), header=True).columns == ["x", "y", "n"]


def test_inverse_of_a_curve_that_falls(spark):
    """Where a curve isn't monotone, the knot with the nearest value is taken."""
    curves = spark.createDataFrame([("r", [0.0, 1.0, 2.0], [0.0, 5.0, 3.0])], "run string, knots array<double>, fitted array<double>")
    rows = spark.createDataFrame([("r", 3.2), ("r", 4.9), ("r", -9.0)], "run string, v double")
    got = {r.v: r.x for r in local_fit.apply_curves(rows, curves, ["run"], "v", "x", inverse=True).collect()}
    assert got == {3.2: 2.0, 4.9: 1.0, -9.0: 0.0}


def test_expectation(spark):
    """Scores whose upper tail falls tenfold every 0.1: a score 0.1 better is ten times rarer; too few scores have no estimate."""
    rows = [("a", b / 50) for b in range(5, 21) for _ in range(int(10 ** (4 - b / 5)))] + [("b", 1.0)] * 9 + [("c", 2.0), *[("c", b / 50) for b in range(5, 21) for _ in range(int(10 ** (4 - b / 5)))]]
    got = {r.k: r for r in evidence.expectation(spark.createDataFrame(rows, "k string, s double"), ["k"], "s").collect()}
    assert got["b"].e_value == 999.0 and 0.1 < got["a"].e_value < 10
    steps = np.log10(got["a"].e_value) - np.log10(got["c"].e_value)
    assert got["c"].best == 2.0 and got["c"].e_value < got["a"].e_value and steps > 2


def test_around_apex(spark):
    """The five scans around the apex; peaks within the tolerance of a group's first are one."""
    rows = [("r", float(i), [(100.0 + 0.01 * i, 1.0), (200.0, float(i))]) for i in range(9)]
    spectra = spark.createDataFrame(rows, "run string, rt double, peaks array<struct<mz:double,intensity:double>>")
    got = sorted(tuple(r) for r in evidence.around_apex(spectra, ["run"], "rt", F.lit(4.2), 0.025).collect())
    assert [(r[0], pytest.approx(r[1]), r[2]) for r in got] == [("r", 100.03, 3.0), ("r", 100.055, 2.0), ("r", 200.0, 20.0)]
