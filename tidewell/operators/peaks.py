"""Peaks of groups of series, and polish profiles, one Spark group per ``keys``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import kernels, tailing

PEAK = "apex long, peak_start long, peak_end long, height double, area double, snr double"


def _matrix(part: pd.DataFrame, row: str, order: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """A row per distinct ``row``, a column per distinct ``order``, zeros where there is no value."""
    rows, i = np.unique(part[row].to_numpy(), return_inverse=True)
    places, j = np.unique(part[order].to_numpy(float), return_inverse=True)
    y = np.zeros((len(rows), len(places)))
    y[i, j] = part[value].to_numpy(float)
    return y, places


def _noise(y: np.ndarray, apex: int, start: int, end: int) -> float:
    flank = np.concatenate((y[max(0, start - 5) : start], y[end + 1 : end + 6]))
    if not len(flank):
        return 0.0
    mean, sd = flank.mean(), flank.std()
    if sd > 1e-10:
        return max(float((y[apex] - mean) / sd), 0.0)
    return float(y[apex] / mean) if abs(mean) > 1e-10 else max(float(y[apex]) * 100, 0.0)


def detect(df: DataFrame, keys: list[str], row: str, order: str, value: str, least: float = 0.01, top: int = 5) -> DataFrame:
    """keys, rank (from 1, highest consensus first) and the peaks on which the rows of a group agree."""
    kinds = dict(df.dtypes)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y, x = _matrix(part, row, order, value)
        total, out = y.sum(axis=0), []
        for n, (apex, start, end) in enumerate(kernels.consensus_peaks(y, least)[:top], 1):
            area = float(np.trapezoid(total[start : end + 1], x[start : end + 1]))
            out.append((*key, n, int(x[apex]), int(x[start]), int(x[end]), float(total[apex]), area, _noise(total, apex, start, end)))
        return pd.DataFrame(out, columns=[*keys, "rank", "apex", "peak_start", "peak_end", "height", "area", "snr"])

    return df.select(*keys, row, order, value).groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", rank int, {PEAK}")


POLISH = ["cosine", "r2", "residual_ratio", "least_r2", "residual_correlation"]


def polish(df: DataFrame, keys: list[str], row: str, order: str, value: str, expected: str | None = None) -> DataFrame:
    """keys, overall, apex (place of the largest column effect) and the features POLISH: median polish of each group's positive values.

    ``expected`` is a column with what is expected of a row (the same at all its places); without it, all rows are expected
    to be alike. Groups of fewer than two rows or three places have none.
    """
    kinds = dict(df.dtypes)
    ideal = F.col(expected).cast("double") if expected else F.lit(1.0)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y, x = _matrix(part, row, order, value)
        names = [*keys, "overall", "apex", *POLISH]
        if y.shape[0] < 2 or y.shape[1] < 3 or not (y > 0).any():
            return pd.DataFrame(columns=names)
        found = kernels.median_polish(y)
        weights = part.groupby(row)["_ideal"].max().to_numpy(float)  # rows in the order of the matrix
        features = kernels.polish_features(y, found, weights)
        return pd.DataFrame([(*key, found[0], int(x[int(np.argmax(found[2]))]), *[features[n] for n in POLISH])], columns=names)

    rows = df.select(*keys, row, order, value, ideal.alias("_ideal"))
    return rows.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", overall double, apex long" + "".join(f", {n} double" for n in POLISH))


TAILING = ["mu", "sigma", "tau", "area", "r_squared", "start", "end"]


def tailing_fit(df: DataFrame, keys: list[str], order: str, value: str, coverage: float = 0.95, least: int = 5) -> DataFrame:
    """keys, mu, sigma, tau, area, r_squared, start, end: the tailing peak closest to each series, and where ``coverage`` of it lies.

    A row of the input is a point. Series are gathered by Spark, padded to the longest of an Arrow batch and fitted together,
    a bounded number at once. Those of fewer than ``least`` points or without positive values have none.
    """
    kinds = dict(df.dtypes)
    point = F.struct(F.col(order).cast("double").alias("x"), F.col(value).cast("double").alias("y"))
    known = df.filter(F.col(order).isNotNull() & F.col(value).isNotNull())
    series = known.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_s")).filter(F.size("_s") >= least)
    rows = series.select(*keys, F.col("_s.x").alias("_x"), F.col("_s.y").alias("_y"))
    together = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, together):
                batch = whole.slice(at, together)
                xs, ys = ([np.asarray(v.values, float) for v in batch.column(c)] for c in ("_x", "_y"))
                x, y, mask = (np.zeros((len(xs), max(map(len, xs)))) for _ in range(3))
                for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
                    x[i, : len(a)], y[i, : len(a)], mask[i, : len(a)] = a, b, 1
                found = tailing.fit(x, y, mask > 0)
                ends = tailing.limits(*found[:, :3].T, coverage)
                good = ~np.isnan(found[:, 0])
                columns = [*found[good].T, *(e[good] for e in ends)]
                kept = batch.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in keys), *map(pa.array, columns)], [*keys, *TAILING])

    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + "".join(f", {n} double" for n in TAILING))
