"""Analytics over ordered series: smoothing, extrema, runs, areas and signal to noise.

A series is the rows of equal ``keys`` in the order of ``order``; ``y`` is its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def smooth(df: DataFrame, keys: list[str], order: list[str], y: str) -> DataFrame:
    """Adds ``smoothed``: five-point quadratic Savitzky-Golay values, 0 at least; two points at each end, and short series, stay as they are."""
    w = _order(keys, order)
    lag = lambda i: F.lag(y, i).over(w) if i > 0 else F.lead(y, -i).over(w)
    value = (-3 * lag(2) + 12 * lag(1) + 17 * F.col(y) + 12 * lag(-1) - 3 * lag(-2)) / 35.0
    inner = lag(2).isNotNull() & lag(-2).isNotNull()
    return df.withColumn("smoothed", F.when(inner, F.greatest(value, F.lit(0.0))).otherwise(F.col(y)))


def local_maxima(df: DataFrame, keys: list[str], order: list[str], y: str, least: float) -> DataFrame:
    """Rows not below either neighbour and at ``least`` high; series ends have one neighbour."""
    w = _order(keys, order)
    marked = df.withColumn("_l", F.lag(y).over(w)).withColumn("_r", F.lead(y).over(w))
    top = F.coalesce(F.col(y) >= F.col("_l"), F.lit(True)) & F.coalesce(F.col(y) >= F.col("_r"), F.lit(True))
    return marked.filter(top & (F.col(y) >= least)).drop("_l", "_r")


def runs_above(df: DataFrame, keys: list[str], order: list[str], y: str, least: float, least_points: int = 1) -> DataFrame:
    """One row per longest run of points at ``least`` or more: keys, run_start, run_end (positions), n_points, apex, total."""
    w = _order(keys, order)
    placed = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_on", F.col(y) >= least)
    on = placed.filter("_on").withColumn("_island", F.col("_i") - F.row_number().over(w))
    found = on.groupBy(*keys, "_island").agg(F.min("_i").alias("run_start"), F.max("_i").alias("run_end"), F.count("*").alias("n_points"), F.max(y).alias("apex"), F.sum(y).alias("total"))
    return found.filter(F.col("n_points") >= least_points).drop("_island")


def trapezoid(df: DataFrame, keys: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """keys, area: by the trapezoid rule; 0 for a single point."""
    w = _order(keys, order)
    part = (F.col(y) + F.lag(y).over(w)) / 2.0 * (F.col(x) - F.lag(x).over(w))
    return df.withColumn("_part", F.coalesce(part, F.lit(0.0))).groupBy(*keys).agg(F.sum("_part").alias("area"))


def apex(df: DataFrame, keys: list[str], order: list[str], y: str) -> DataFrame:
    """The highest row of each series, the last one on a tie."""
    best = W.partitionBy(*keys).orderBy(F.col(y).desc(), *[F.col(c).desc() for c in order])
    return df.withColumn("_nth", F.row_number().over(best)).filter("_nth = 1").drop("_nth")


def dense_windows(df: DataFrame, keys: list[str], order: list[str], passes: Column, length: int = 4, least: int = 3) -> DataFrame:
    """Keys with a stretch of ``length`` consecutive rows of which ``least`` pass; shorter series have none."""
    w = _order(keys, order)
    counted = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.sum(passes.cast("int")).over(w.rowsBetween(1 - length, 0)))
    return counted.filter((F.col("_i") >= length) & (F.col("_n") >= least)).select(*keys).distinct()


def signal_to_noise(df: DataFrame, keys: list[str], order: list[str], y: str, flank: int = 5, half_width: int = 2) -> DataFrame:
    """keys, snr: the apex against up to ``flank`` points on each side beyond ``half_width`` points from it.

    (apex - mean) / population standard deviation, 0 at least. Without spread: apex / mean,
    or 100 times the apex if the mean is 0 too. 0 without any flanking point.
    """
    w = _order(keys, order)
    placed = df.select(*keys, F.row_number().over(w).alias("_i"), F.col(y).alias("_y"))
    top = placed.groupBy(*keys).agg(F.max(F.struct("_y", "_i")).alias("_top"))
    offset = F.abs(F.col("_i") - F.col("_top._i"))
    beside = placed.join(top, keys).withColumn("_off", offset)
    flanking = F.when((F.col("_off") > half_width) & (F.col("_off") <= half_width + flank), F.col("_y"))
    stats = beside.groupBy(*keys).agg(F.max("_top._y").alias("a"), F.avg(flanking).alias("m"), F.stddev_pop(flanking).alias("s"))
    flat = F.when(F.abs("m") > 1e-10, F.col("a") / F.col("m")).when(F.col("a") > 0, F.col("a") * 100).otherwise(0.0)
    snr = F.when(F.col("m").isNull(), 0.0).when(F.col("s") > 1e-10, F.greatest((F.col("a") - F.col("m")) / F.col("s"), F.lit(0.0))).otherwise(flat)
    return stats.select(*keys, snr.alias("snr"))


def moving_mean_deviation(df: DataFrame, keys: list[str], order: list[str], residual: str, half: int = 2) -> DataFrame:
    """Adds ``local``: the mean absolute residual over ``half`` rows on each side, fewer at the ends."""
    w = _order(keys, order).rowsBetween(-half, half)
    return df.withColumn("local", F.avg(F.abs(residual)).over(w))
