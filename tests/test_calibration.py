"""Calibration of simulated runs whose time scale is known, and the sample against plain Python."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidewell.functions import kernels
from tidewell.operators import calibration, local_fit, stats

ENTRY = "entry_id long, base long, precursor_mz double, rt double, fragments array<struct<mz:double,intensity:double>>, decoy boolean"
SPECTRUM = "file_name string, scan long, rt double, iso_low double, iso_high double, mzs array<double>, intensities array<double>"


def warp(t):
    return 2 + 0.9 * t + 0.6 * np.sin(t / 4)


def simulated(n=60, seed=1):
    rng = np.random.default_rng(seed)
    entries, shapes = [], []
    for i in range(n):
        rt, mz = float(rng.uniform(0, 30)), float(400 + rng.uniform(0, 8))
        frags = sorted(rng.uniform(200, 900, 6))
        heights = rng.uniform(0.2, 1, 6)
        entries.append((i, i, mz, rt, [(float(m), float(h)) for m, h in zip(frags, heights)], False))
        entries.append((i | 1 << 31, i, mz, rt, [(float(m + 3.7), float(h)) for m, h in zip(frags, heights)], True))
        shapes.append((rt, frags, heights))
    spectra = []
    for name, shift_ppm, empty in (("a", 3.0, False), ("b", -2.0, False), ("none", 0.0, True)):
        for s in range(330):
            t, peaks = s * 0.1, []
            for rt, frags, heights in shapes:
                y = 0 if empty else 1e4 * math.exp(-((t - warp(rt)) ** 2) / 2 / 0.15**2)
                if y > 1:
                    peaks += [(float(m * (1 + shift_ppm / 1e6)), float(y * h)) for m, h in zip(frags, heights)]
            peaks += [(float(m), 5.0) for m in rng.uniform(150, 950, 30)]
            peaks.sort()
            spectra.append((name, s, t, 399.0, 409.0, [p[0] for p in peaks], [p[1] for p in peaks]))
    return entries, spectra


def test_known_time_scale(spark):
    entries, spectra = simulated()
    e, s = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(spectra, SPECTRUM)
    settings = calibration.Settings(sample=15, growth=2.0, enough=25, fewest=20, threshold=0.05, narrowest=1.0, ppm=10.0)
    found = calibration.calibrate(e, s, settings)
    rows = {(r.file_name, r.attempt): r for r in found.attempts.collect()}
    assert rows["a", 1].state == "again" and rows["a", 1].sampled == 15 and rows["a", 1].passing < 25
    assert rows["none", 3].state == "failed" and rows["none", 3].passing == 0 and rows["none", 3].sampled == 60
    for run, shift in (("a", 3.0), ("b", -2.0)):
        last = max(a for r, a in rows if r == run)
        r = rows[run, last]
        assert r.state == "done" and r.refined and r.tolerance <= r.first_tolerance < r.searched / 2
        assert r.matched >= rows[run, 1].matched
        mass = found.masses.filter(F.col("file_name") == run).first()
        assert abs(mass["mean"] - shift) < 0.5 and abs(mass["median"] - shift) < 0.3
    assert {r.file_name for r in found.curves.select("file_name").collect()} == {"a", "b"}
    probe = spark.createDataFrame([(run, float(t)) for run in "ab" for t in range(4, 27)], "file_name string, rt double")
    off = [abs(r.at - warp(r.rt)) for r in local_fit.apply_curves(probe, found.curves, ["file_name"], "rt", "at").collect()]
    assert np.median(off) < 0.1 and max(off) < 0.5


def test_nothing_found(spark):
    entries, spectra = simulated(6)
    e, s = spark.createDataFrame(entries, ENTRY), spark.createDataFrame([r for r in spectra if r[0] == "none"], SPECTRUM)
    found = calibration.calibrate(e, s, calibration.Settings(sample=0))
    assert [(r.state, r.attempt) for r in found.attempts.collect()] == [("failed", 1)]
    assert found.curves.count() == 0 and found.masses.count() == 0


def test_stride_sample(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(0, 1, (400, 2)), rng.uniform(-9, 9, (60, 2))]))]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    for size, seed in ((50, 7), (100, 44), (459, 3), (460, 1), (900, 1), (3, 0)):
        got = {r.id for r in stats.stride_sample(df, "x", "y", "id", size, seed).collect()}
        bins = max(5, math.ceil(math.sqrt(size) / 2))
        lo, hi = [min(r[k] for r in rows) for k in (1, 2)], [max(r[k] for r in rows) for k in (1, 2)]
        cells = {}
        for r in rows:
            cells.setdefault(tuple(min(math.floor((r[k] - lo[k - 1]) / ((hi[k - 1] - lo[k - 1]) / bins)), bins - 1) for k in (1, 2)), []).append(r[0])
        share, order = max(1, size // len(cells)), []
        for cell, ids in cells.items():
            take = min(share, len(ids))
            stride = max(1, len(ids) // take)
            first = [ids[(seed + j * stride) % len(ids)] for j in range(take)]
            order += [(0, j, *cell, i) for j, i in enumerate(first)]
            order += [(1, j, *cell, i) for j, i in enumerate((i for i in ids if i not in first), 1)]
        assert got == {o[-1] for o in sorted(order)[:size]} and len(got) == min(size, 460)


def test_knots_of_many_points(spark):
    """Above MAX_KNOTS points a curve has its knots at means of even ranges: it differs from the fit to all points by under a hundredth of their spread."""
    rng = np.random.default_rng(8)
    x = np.sort(np.concatenate([rng.uniform(0, 30, 3000), rng.normal(12, 0.5, 3000)]))
    y = warp(x) + rng.normal(0, 0.4, len(x))
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "file_name string, x double, y double")
    curves = local_fit.fit_curves(df, ["file_name"], "x", "y", passes=0)
    row = curves.first()
    assert row.n == 6000 and len(row.knots) <= local_fit.MAX_KNOTS
    every = kernels.local_lines(x, y, np.ones(len(x)), np.ones(len(x)), 0.3)
    off = np.abs(np.interp(x, row.knots, row.fitted) - every)
    assert off.max() < 0.1 * 0.4 and off.mean() < 0.01 * 0.4
