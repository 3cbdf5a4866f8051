"""Searching spectra for catalogue entries: candidates, series, peaks, scores.

Entries meet the isolation windows by a range join, the window's scans by time, and each
expected fragment the closest measured peak by array functions; all of it is joins and
column expressions. Only the agreed peak of an entry's series is found in Python, a group
per entry and run.

``entries``: entry_id, precursor_mz, rt, fragments (array of mz, intensity), decoy.
``spectra``: file_name, scan, rt, iso_low, iso_high, mzs (sorted), intensities.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import kernels
from tidewell.operators.joins import range_join
from tidewell.operators.local_fit import place

TOP_FRAGMENTS = 6


def top_fragments(fragments: Column, n: int = TOP_FRAGMENTS) -> Column:
    """The ``n`` most intense fragments, earlier ones first on a tie."""
    placed = F.transform(fragments, lambda f, i: F.struct((-f.intensity).alias("o"), i.alias("i"), f.mz.alias("mz"), f.intensity.alias("intensity")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda f: F.struct(f.mz.alias("mz"), f.intensity.alias("intensity")))


def closest_intensity(mz: Column, peaks: Column, ppm: float) -> Column:
    """Intensity of the peak (mz, intensity) closest to ``mz`` within ``ppm``, the lower one on a tie, 0 without any.

    Peaks are sorted by place, so the band is cut out by halving and only its peaks are compared.
    """
    width = mz * ppm / 1e6
    low, high = place(peaks, mz - width, "mz"), place(peaks, mz + width, "mz", equal=True)
    near = F.slice(peaks, low + 1, F.greatest(high - low, F.lit(0)))
    best = F.array_min(F.transform(near, lambda p: F.struct(F.abs(p.mz - mz).alias("d"), p.mz.alias("m"), p.intensity.cast("double").alias("y"))))
    return F.coalesce(best.y, F.lit(0.0))


def windows(spectra: DataFrame) -> DataFrame:
    """Isolation windows of each run with their time span; bounds equal to a tenth are one window, the first scan's."""
    tenth = [F.floor(F.col(c) * 10).alias(f"_{c}") for c in ("iso_low", "iso_high")]
    grouped = spectra.groupBy("file_name", *tenth)
    return grouped.agg(F.min_by(F.struct("iso_low", "iso_high"), "scan").alias("b"), F.min("rt").alias("first_rt"), F.max("rt").alias("last_rt")).select("file_name", F.col("_iso_low").alias("low_key"), F.col("_iso_high").alias("high_key"), "b.iso_low", "b.iso_high", "first_rt", "last_rt")


def candidates(entries: DataFrame, spectra: DataFrame, rt_tolerance: float, expected: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Entries in each window that selects their precursor while they are expected.

    ``expected`` turns an entry's rt into the time at which it is expected in a run; it gets rows with file_name and rt.
    """
    met = range_join(entries.withColumn("fragments", top_fragments(F.col("fragments"))), windows(spectra), "precursor_mz", "iso_low", "iso_high", 25.0)
    met = expected(met) if expected else met
    return met.filter((F.col("rt") >= F.col("first_rt") - rt_tolerance) & (F.col("rt") <= F.col("last_rt") + rt_tolerance))


def series(entries: DataFrame, spectra: DataFrame, rt_tolerance: float, ppm: float, expected: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """file_name, entry_id, scan, scan_rt, values: each fragment's intensity at each scan in reach, zeros included.

    Scans meet entries by window and by time cells of the tolerance, three cells for each
    entry, so a long run isn't paired with every entry.
    """
    found = candidates(entries, spectra, rt_tolerance, expected).withColumnRenamed("rt", "expected_rt")
    found = found.withColumn("_cell", F.explode(F.array(*[F.floor(F.col("expected_rt") / rt_tolerance) + i for i in (-1, 0, 1)])))
    scans = spectra.select("file_name", "scan", F.col("rt").alias("scan_rt"), F.floor(F.col("iso_low") * 10).alias("low_key"), F.floor(F.col("iso_high") * 10).alias("high_key"), F.floor(F.col("rt") / rt_tolerance).alias("_cell"), F.arrays_zip(F.col("mzs").alias("mz"), F.col("intensities").alias("intensity")).alias("peaks"))
    met = found.join(scans, ["file_name", "low_key", "high_key", "_cell"]).filter(F.abs(F.col("scan_rt") - F.col("expected_rt")) <= rt_tolerance)
    values = F.transform("fragments", lambda f: closest_intensity(f.mz, F.col("peaks"), ppm))
    return met.select("file_name", "entry_id", "decoy", "expected_rt", "scan", "scan_rt", F.transform("fragments", lambda f: f.intensity.cast("double")).alias("expected"), values.alias("values"))


def prefiltered(rows: DataFrame, least_fragments: int = 2, length: int = 4, least: int = 3) -> DataFrame:
    """Entries with some ``length`` scans in a row of which ``least`` show ``least_fragments`` fragments."""
    w = W.partitionBy("file_name", "entry_id").orderBy("scan")
    shown = (F.size(F.filter("values", lambda v: v > 0)) >= F.least(F.lit(least_fragments), F.size("values"))).cast("int")
    passed = rows.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.sum(shown).over(w.rowsBetween(1 - length, 0)))
    keep = passed.filter((F.col("_i") >= length) & (F.col("_n") >= least)).select("file_name", "entry_id").distinct()
    return rows.join(keep, ["file_name", "entry_id"], "left_semi")


SHAPE = ["coelution_max", "n_coeluting", "sharpness", "smoothed_cosine", "elution_cosine", "polish_cosine", "polish_ratio", "polish_least_r2", "polish_correlation"]
SCORES = "file_name string, entry_id long, decoy boolean, expected_rt double, apex_rt double, start_rt double, end_rt double, apex double, area double, snr double, coelution double, similarity double, n_fragments int, " + "".join(f"{n} double, " for n in SHAPE) + "rank_score double, profile_rt array<double>, profile array<double>, rank int"
#: Weights of the five scans around an apex (quadratic smoothing).
SMOOTHING = (-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35)


def root_cosines(expected: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of the roots of ``expected`` and of each column of ``y``, 0 for empty ones."""
    size = np.sqrt(expected.sum() * y.sum(axis=0))
    return np.divide(np.sqrt(expected) @ np.sqrt(y), size, out=np.zeros(y.shape[1]), where=size > 1e-12)


def shape_features(y: np.ndarray, rt: np.ndarray, expected: np.ndarray, peak: tuple[int, int, int]) -> list[float]:
    """SHAPE of a peak (apex, start, end) in fragments' series (a row each): how alike they are within it, and how like the expected ones.

    The fragment with the largest sum is the reference, for the slopes to the apex and for the weights of scans.
    """
    apex, start, end = peak
    used = (y > 0).any(axis=1)
    cut = y[used, start : end + 1]
    spread = cut.std(axis=1) > 0
    r = np.zeros((len(cut), len(cut)))
    if spread.sum() > 1:
        r[np.ix_(spread, spread)] = np.corrcoef(cut[spread])
    np.fill_diagonal(r, 0)
    pairs = r[np.triu_indices(len(cut), 1)]
    reference = y[int(np.argmax(y.sum(axis=1)))]
    slopes = [(reference[apex] - reference[i]) / abs(rt[apex] - rt[i]) if i != apex and abs(rt[apex] - rt[i]) > 1e-10 else 0.0 for i in (start, end)]
    cosines = root_cosines(expected, y)
    smoothed = sum(w * cosines[apex + k] for k, w in zip(range(-2, 3), SMOOTHING, strict=True) if 0 <= apex + k < len(cosines))
    weights = np.maximum(reference[start : end + 1], 0) ** 2
    elution = weights @ cosines[start : end + 1] / weights.sum() if weights.sum() > 0 else 0.0
    inner = y[:, start : end + 1]
    polish = {"cosine": 0.0, "residual_ratio": 1.0, "least_r2": 0.0, "residual_correlation": 0.0}
    if inner.shape[0] >= 2 and inner.shape[1] >= 3 and (inner > 0).any():
        polish = kernels.polish_features(inner, kernels.median_polish(inner), expected)
    return [float(pairs.max(initial=-1.0)) if len(pairs) else 0.0, float((r[:6].sum(axis=1) > 0).sum()), float(sum(slopes) / 2), float(smoothed), float(elution), *[polish[n] for n in ("cosine", "residual_ratio", "least_r2", "residual_correlation")]]


def score(rows: DataFrame, rt_sigma: float, top: int = 1) -> DataFrame:
    """The ``top`` best peaks of each entry and run by mean correlation, closeness to the expected time and height.

    profile_rt, profile: times and heights of the reference fragment (that with the largest sum) from start to end.
    """
    sigma = max(rt_sigma, 0.1)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("scan")
        y, rt, out = np.array(part["values"].tolist(), float).T, part["scan_rt"].to_numpy(float), []
        used = y[(y > 0).any(axis=1)]
        expected, total, reference = np.array(part["expected"].iloc[0], float), y.sum(axis=0), y[int(np.argmax(y.sum(axis=1)))]
        for apex, start, end in kernels.consensus_peaks(used, 0.01):
            cut = used[:, start : end + 1]
            spread = cut.std(axis=1) > 0
            pairs = np.corrcoef(cut[spread])[np.triu_indices(int(spread.sum()), 1)] if spread.sum() > 1 else np.zeros(1)
            off = rt[apex] - part["expected_rt"].iloc[0]
            flank = np.concatenate((total[max(0, start - 5) : start], total[end + 1 : end + 6]))
            noise = max(0.0, (total[apex] - flank.mean()) / flank.std()) if len(flank) and flank.std() > 1e-10 else 0.0
            root = np.sqrt(expected) @ np.sqrt(y[:, apex]) / max(np.sqrt(expected.sum() * y[:, apex].sum()), 1e-12)
            rank = pairs.mean() * np.exp(-off * off / 2 / sigma**2) * np.log1p(total[apex])
            area = np.trapezoid(total[start : end + 1], rt[start : end + 1])
            within = slice(start, end + 1)
            out.append((rt[apex], rt[start], rt[end], total[apex], area, noise, pairs.sum(), root, int((y[:, apex] > 0).sum()), *shape_features(y, rt, expected, (apex, start, end)), rank, rt[within], reference[within]))
        out.sort(key=lambda r: -r[-3])
        first = part.iloc[0]
        return pd.DataFrame([(first["file_name"], first["entry_id"], first["decoy"], first["expected_rt"], *r, n) for n, r in enumerate(out[:top], 1)], columns=[c.split()[0] for c in SCORES.split(", ")])

    return rows.groupBy("file_name", "entry_id").applyInPandas(one, SCORES)


def search(entries: DataFrame, spectra: DataFrame, rt_tolerance: float = 2.0, ppm: float = 10.0, top: int = 1, expected: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Scored peaks, the ``top`` best of each entry and run with their rank from 1."""
    return score(prefiltered(series(entries, spectra, rt_tolerance, ppm, expected)), rt_tolerance / 2, top)
