"""Fast cross-correlation of spectra with catalogue entries, over sparse (scan, bin, value) rows.

A spectrum is prepared by roots in bins, ten windows scaled to 50, and the mean of the 75
bins on either side taken off. That mean makes every bin near a peak non-zero, so prepared
spectra are neither kept nor shuffled: scans are cut into blocks by a hash of their keys,
and a task prepares one block of them, BLOCK_BINS bins together, in memory. The pairs of a
block come to it with the distinct bins of their entries in one array of short numbers, a
row for each pair; a block with many pairs is dealt to several cells by a hash of the entry.
The score of a candidate is a sum over its bins. Values are double precision.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.arrays import bin_of
from tidewell.storage import stored

#: Bins of one unit, their offset, the largest place, windows, their height, the share of the largest value that is noise.
WIDTH, OFFSET, TOP = 1.0005079, 0.4, 2000.0
WINDOWS, HEIGHT, NOISE = 10, 50.0, 0.05
#: Bins on either side whose mean is taken off, by how many it is divided, and the scale of the score.
REACH, AROUND, SCALE = 75, 150.0, 0.005
#: Bins of the spectra of a block together, pairs of a cell, on average; bins asked for that are looked up at once.
BLOCK_BINS, CELL_PAIRS, LOOKED_UP = 1_000_000, 300_000, 1_000_000


def n_bins(width: float = WIDTH, offset: float = OFFSET, top: float = TOP) -> int:
    return int(top / width + 1 - offset) + 1


def binned(peaks: DataFrame, keys: list[str], mz: str, intensity: str, width: float = WIDTH, offset: float = OFFSET, top: float = TOP) -> DataFrame:
    """keys, bin, value: the summed roots of intensities in each bin that has a peak."""
    placed = peaks.withColumn("bin", bin_of(F.col(mz), width, offset, top)).filter("bin IS NOT NULL")
    return placed.groupBy(*keys, "bin").agg(F.sum(F.sqrt(F.col(intensity).cast("double"))).alias("value"))


def unit_bins(fragments: DataFrame, entry: str, mz: str, width: float = WIDTH, offset: float = OFFSET, top: float = TOP) -> DataFrame:
    """entry, bins: the bins that an entry's fragments fall in, each once."""
    kind = "short" if n_bins(width, offset, top) < 2**15 else "int"
    placed = fragments.select(entry, bin_of(F.col(mz), width, offset, top).cast(kind).alias("bin")).filter("bin IS NOT NULL")
    return placed.groupBy(entry).agg(F.collect_set("bin").alias("bins"))


def prepared(row: np.ndarray, at: np.ndarray, value: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """Dense spectra: windows scaled to HEIGHT, values up to NOISE of the scan's largest left out, the mean of those around taken off."""
    span = bins // WINDOWS + 1
    x = np.zeros((rows, WINDOWS * span))
    x[row, at] = value
    local = np.repeat(x.reshape(rows, WINDOWS, span).max(axis=2), span, axis=1)
    x = np.where(x > NOISE * x.max(axis=1, keepdims=True), HEIGHT * x / np.where(local > 0, local, 1.0), 0.0)[:, :bins]
    upto = np.concatenate([np.zeros((rows, 1)), np.cumsum(x, axis=1)], axis=1)
    places = np.arange(bins)
    near = upto[:, np.minimum(places + REACH + 1, bins)] - upto[:, np.maximum(places - REACH, 0)]
    return x - (near - x) / AROUND


def _numbered(spectra: pa.Table, asked: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the distinct scans of ``spectra`` for its rows and for those of ``asked`` (-1: none), and how many there are."""
    n = spectra.num_rows
    code, known = np.zeros(n + asked.num_rows, np.int64), np.ones(n + asked.num_rows, bool)
    for k in keys:
        column = pa.chunked_array([*spectra[k].chunks, *asked[k].chunks], spectra.schema.field(k).type).combine_chunks().dictionary_encode()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        own = column.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        known &= own >= 0
        code = np.unique(code * (len(column.dictionary) + 1) + own + 1, return_inverse=True)[1]
    scans, number = np.unique(code[:n], return_inverse=True)
    theirs = code[n:]
    at = np.minimum(np.searchsorted(scans, theirs), max(len(scans) - 1, 0))
    found = known[n:] & (scans[at] == theirs) if len(scans) else np.zeros(len(theirs), bool)
    return number, np.where(found, at, -1), len(scans)


def cross_correlation(pairs: DataFrame, fragments: DataFrame, peaks: DataFrame, keys: list[str], entry: str, mz: str, intensity: str, width: float = WIDTH, offset: float = OFFSET, top: float = TOP) -> DataFrame:
    """``pairs`` (keys, entry) with ``xcorr``; 0 for entries without fragments and for scans without peaks.

    ``fragments`` has (entry, mz), ``peaks`` (keys, mz, intensity).
    """
    bins, kinds = n_bins(width, offset, top), dict(peaks.select(*keys).dtypes)
    pairs = stored(pairs, "pairs")
    scans = peaks.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    block = F.pmod(F.xxhash64(*[F.col(k).cast(kinds[k]) for k in keys]), F.lit(ceil((scans + 1) * bins / BLOCK_BINS))).cast("int").alias("_i")
    cells = pairs.groupBy(block).agg(F.ceil(F.count("*") / CELL_PAIRS).cast("int").alias("_cells"))  # a row per block
    wanted = pairs.join(unit_bins(fragments, entry, mz, width, offset, top), entry, "left").select(*pairs.columns, F.col("bins").alias("_bins"), block)
    wanted = wanted.join(F.broadcast(cells), "_i").withColumn("_j", F.pmod(F.xxhash64(entry), F.col("_cells")).cast("int")).drop("_cells")
    spectra = binned(peaks, keys, mz, intensity, width, offset, top).select(*keys, F.col("bin").cast("int").alias("bin"), "value", block)
    spectra = spectra.join(F.broadcast(cells), "_i").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).drop("_cells")

    def scored(asked: pa.Table, shown: pa.Table) -> pa.Table:
        number, mine, n = _numbered(shown, asked, keys)
        values = prepared(number, shown["bin"].to_numpy(), shown["value"].fill_null(0.0).to_numpy(), n, bins)
        lists = asked["_bins"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.where(mine >= 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        starts, score = lists.offsets.to_numpy()[:-1], np.zeros(len(mine))
        flat, upto = lists.values.to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        first = 0
        while first < len(mine):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + LOOKED_UP, "right")) - 1)
            own = np.repeat(np.arange(first, last), sizes[first:last])
            at = flat[starts[own] + np.arange(upto[first], upto[last]) - upto[own]]
            score[first:last] = np.bincount(own - first, values[mine[own], at], last - first) * SCALE
            first = last
        return asked.drop_columns(["_bins", "_i", "_j"]).append_column("xcorr", pa.array(score))

    schema = pairs.schema.add("xcorr", "double")
    return wanted.groupBy("_i", "_j").cogroup(spectra.groupBy("_i", "_j")).applyInArrow(scored, schema)
