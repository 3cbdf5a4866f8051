"""Features of survey scans against NumPy over the same scans, and their defined cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.sequences import composition
from tidewell.operators import acquisition, apex, survey

SURVEY = "file_name string, scan long, rt double, mzs array<double>, intensities array<double>"
FOUND = "file_name string, entry_id long, apex_rt double, profile_rt array<double>, profile array<double>"
ENTRY = "entry_id long, precursor_mz double, charge int, sequence string"


def brute_peak(scan, mz, ppm):
    near = [(y, -m) for m, y in zip(scan[3], scan[4]) if abs(m - mz) <= mz * ppm / 1e6 and y > 0]
    return max(near) if near else (0.0, None)


def simulated(spark, seed=4):
    rng = np.random.default_rng(seed)
    sequences = ["PEPTIDEK", "LSSPATLNSR", "MCCYK", "AAAGGGK"]
    entries = [(i, float(400 + 7.3 * i), 1 + i % 3, sequences[i % 4]) for i in range(24)]
    surveys, found = [], []
    for run in ("a", "b"):
        for s in range(40):
            peaks = [(float(rng.uniform(395, 590)), float(rng.uniform(1, 9))) for _ in range(200)]
            for i, mz, charge, _ in entries:
                for k in range(-1, 4):
                    for _ in range(2):
                        peaks.append((float((mz + k * 1.002868 / charge) * (1 + rng.normal(2, 4) / 1e6)), float(rng.uniform(0, 100) * (s + 1))))
            peaks.sort()
            surveys.append((run, s, s * 0.5 + (0.1 if run == "b" else 0.0), [p[0] for p in peaks], [p[1] for p in peaks]))
        for i, *_ in entries:
            n = int(rng.integers(1, 9))
            times = sorted(float(t) for t in rng.choice(np.arange(0, 20, 0.25), n, replace=False))
            found.append((run, i, times[n // 2], times, [float(v) for v in rng.uniform(0, 50, n)]))
    return entries, surveys, found


@pytest.mark.parametrize("calibrated", [False, True])
def test_features_equal_brute_force(spark, calibrated):
    entries, surveys, found = simulated(spark)
    e, s, f = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(surveys, SURVEY), spark.createDataFrame(found, FOUND)
    masses = spark.createDataFrame([("a", 2.0, 5.0)], "file_name string, mean double, tolerance double") if calibrated else None
    got = {(r.file_name, r.entry_id): r for r in survey.with_survey_features(f, e, s, 10.0, masses).collect()}
    shares = {r.entry_id: r.t for r in e.select("entry_id", acquisition.isotope_distribution(composition(F.col("sequence"))).alias("t")).collect()}
    assert len(got) == len(found)
    seen = 0
    for run, i, apex_rt, times, heights in found:
        scans, (_, mz, charge, _) = [x for x in surveys if x[0] == run], entries[i]
        mean, ppm = (2.0, 5.0) if calibrated and run == "a" else (0.0, 10.0)
        nearest = lambda t: min(scans, key=lambda x: (abs(x[2] - t), x[2]))  # noqa: E731, B023
        place = lambda k: (mz + k * 1.002868 / charge) * (1 + mean / 1e6)  # noqa: E731, B023
        y = [brute_peak(nearest(t), place(0), ppm)[0] for t in times]
        want = np.corrcoef(y, heights)[0, 1] if len(y) >= 3 and np.ptp(y) > 0 and np.ptp(heights) > 0 else 0.0
        assert got[run, i].survey_coelution == pytest.approx(want, abs=1e-9)
        shown = np.array([brute_peak(nearest(apex_rt), place(k), ppm)[0] for k in range(-1, 4)])
        theory = np.array([0.0, *shares[i][:4]])
        want = shown @ theory / np.linalg.norm(shown) / np.linalg.norm(theory) if shown[1] > 0 else 0.0
        assert got[run, i].survey_isotopes == pytest.approx(want, abs=1e-9)
        seen += want > 0
    assert seen > 30


def test_defined_cases(spark):
    """Runs without survey scans, entries without sequence, no matches, no scans, ties of time and intensity."""
    found = spark.createDataFrame([("a", 1, 1.0, [0.5, 1.0, 1.5], [1.0, 2.0, 3.0]), ("none", 1, 1.0, [0.5, 1.0, 1.5], [1.0, 2.0, 3.0]), ("a", 2, 1.0, [], [])], FOUND)
    surveys = spark.createDataFrame([("a", 0, 0.0, [500.0, 500.001], [4.0, 4.0]), ("a", 1, 1.0, [500.0], [7.0]), ("a", 2, 2.0, [], [])], SURVEY)
    entries = spark.createDataFrame([(1, 500.0), (2, 600.0)], "entry_id long, precursor_mz double")
    got = {(r.file_name, r.entry_id): (r.survey_coelution, r.survey_isotopes) for r in survey.with_survey_features(found, entries, surveys).collect()}
    assert got["none", 1] == got["a", 2] == (0.0, 0.0)
    assert got["a", 1] == (pytest.approx(np.corrcoef([4, 7, 7], [1, 2, 3])[0, 1]), 0.0)  # 0.5 is as near to 0 as to 1
    asked = surveys.limit(0).select("file_name", "scan").unionByName(spark.createDataFrame([("a", 0)], "file_name string, scan long")).withColumn("mz", F.lit(500.0)).withColumn("id", F.lit(1))
    assert survey.most_intense(asked, surveys, ["id"], 10.0).first()[:] == (1, 500.0, 4.0)
    assert survey.with_survey_features(found.limit(0), entries, surveys).count() == 0
    assert {r.survey_coelution for r in survey.with_survey_features(found, entries, surveys.limit(0)).collect()} == {0.0}


def test_errors_of_runs(spark):
    entries, surveys, found = simulated(spark)
    e, s, f = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(surveys, SURVEY), spark.createDataFrame(found, FOUND)
    got = {r.file_name: r for r in survey.survey_errors(f, e, s, 15.0).collect()}
    for run in ("a", "b"):
        scans, errors = [x for x in surveys if x[0] == run], []
        for r, i, apex_rt, *_ in found:
            y, m = brute_peak(min(scans, key=lambda x: (abs(x[2] - apex_rt), x[2])), entries[i][1], 15.0)
            if r == run and y:
                errors.append((-m - entries[i][1]) / entries[i][1] * 1e6)
        assert got[run].n == len(errors) and got[run]["mean"] == pytest.approx(np.mean(errors)) and got[run].sd == pytest.approx(np.std(errors, ddof=1))


def test_longest_ions(spark):
    rows = spark.createDataFrame([([("b", 2, 1.0), ("B", 3, None), ("b", 4, 1.0), ("y", 5, 1.0), ("y", 6, 2.0), ("y", 9, 1.0), ("p", 7, 1.0)],), ([],)], "f array<struct<ion_type:string,ordinal:int,x:double>>")
    got = rows.select(apex.longest_ions(F.col("f"), F.transform("f", lambda x: x.x)).alias("n")).collect()
    assert [r.n for r in got] == [2, 0]
