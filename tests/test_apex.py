"""Features of matches in simulated runs against NumPy over the same scans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_calibration import ENTRY, SPECTRUM, simulated

from tidewell.functions import kernels
from tidewell.operators import apex, search, survey


def test_features_of_matches(spark):
    entries, spectra = simulated(14)
    entries = [(e[0], e[1], e[2], 2 + 0.9 * e[3], e[4], e[5]) for e in entries]
    spectra = [s for s in spectra if s[0] == "a"]
    e, s = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(spectra, SPECTRUM)
    found = search.search(e, s, rt_tolerance=2.0, ppm=10.0)
    scans = spark.createDataFrame([("a", k, k / 2, [x[2] for x in entries if not x[5]], [100.0 * k] * 14) for k in range(60)], "file_name string, scan long, rt double, mzs array<double>, intensities array<double>").withColumn("mzs", F.array_sort("mzs"))
    rows = {r.entry_id: r for r in apex.with_apex_features(survey.with_survey_features(found, e, scans), e, s, 10.0).collect()}
    targets = [x for x in entries if not x[5]]
    assert len(set(rows) & {x[0] for x in targets}) >= 12
    prepared = [kernels.binned_correlation_spectrum(np.array(x[5]), np.array(x[6])) for x in spectra]
    checked = 0
    for entry_id, _, _, rt, fragments, decoy in targets:
        if entry_id not in rows:
            continue
        r = rows[entry_id]
        at = min(range(len(spectra)), key=lambda i: abs(spectra[i][2] - r.apex_rt))
        mz, y = np.array(spectra[at][5]), np.array(spectra[at][6])
        places = np.array([f[0] for f in fragments])
        corr = [kernels.cross_correlation(prepared[i], places) if 0 <= i < len(spectra) else 0.0 for i in range(at - 2, at + 3)]
        assert r.xcorr == pytest.approx(corr[2], abs=2e-3)
        assert r.smoothed_xcorr == pytest.approx(np.dot(corr, search.SMOOTHING), abs=2e-3)
        errors, taken = [], 0.0
        for p in places:
            i = int(np.argmin(np.abs(mz - p)))
            if abs(mz[i] - p) <= p * 10 / 1e6:
                errors.append((mz[i] - p) / p * 1e6)
                taken += y[i]
        assert r.explained == pytest.approx(taken / y.sum()) and r.mass_error == pytest.approx(np.mean(errors)) and r.abs_mass_error == pytest.approx(np.mean(np.abs(errors)))
        assert r.rt_off == pytest.approx(r.apex_rt - rt) and r.abs_rt_off == abs(r.rt_off)
        assert abs(r.mass_error - 3.0) < 1.0 and r.coelution_max > 0.95 and r.n_coeluting == 6 and r.sharpness > 0
        assert r.polish_cosine > 0.95 and r.elution_cosine > 0.95 and r.polish_least_r2 > 0.8 and 0 <= r.polish_ratio < 0.5
        assert len(r.profile) == len(r.profile_rt) and r.profile_rt[0] == r.start_rt and r.profile_rt[-1] == r.end_rt and r.consecutive == 0
        assert all(r[n] is not None for n in apex.MODEL_FEATURES)
        checked += 1
    assert checked >= 12


def test_shape_features_by_hand():
    rt = np.arange(9.0)
    base = np.array([0, 1, 4, 9, 16, 9, 4, 1, 0.0])
    y = np.stack([base, 2 * base, np.zeros(9)])
    got = dict(zip(search.SHAPE, search.shape_features(y, rt, np.array([1.0, 2.0, 1.0]), (4, 1, 7)), strict=True))
    cosine = 3 / np.sqrt(4 * 3)
    assert got["coelution_max"] == pytest.approx(1) and got["n_coeluting"] == 2 and got["sharpness"] == pytest.approx(10)
    assert got["elution_cosine"] == pytest.approx(cosine) and got["smoothed_cosine"] == pytest.approx(cosine)
    flat = search.shape_features(np.zeros((2, 5)), np.arange(5.0), np.ones(2), (2, 1, 3))
    assert flat[:5] == [0.0, 0.0, 0.0, 0.0, 0.0]
