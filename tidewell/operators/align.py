"""Agreement between runs: consensus places, reconciliation plans, calibration lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.stats import MIDDLE, order_statistics, weighted_median


def consensus(rows: DataFrame, keys: list[str], place: str, width: str, score: str, run: str) -> DataFrame:
    """keys, place, width, n_runs, mad: weighted medians over runs, weights 1/(1+e^-score), 1e-6 at least; mad from three runs on."""
    weighted = rows.withColumn("_w", F.greatest(1 / (1 + F.exp(-F.col(score))), F.lit(1e-6)))
    places = weighted_median(weighted, keys, place, "_w").withColumnRenamed("median", place)
    widths = weighted_median(weighted, keys, width, "_w").withColumnRenamed("median", width)
    both = places.join(widths, keys)
    center = both.select(*keys, F.col(place).alias("_c"))
    off = rows.join(center, keys).select(*keys, run, F.abs(F.col(place) - F.col("_c")).alias("_off"))
    runs = off.groupBy(*keys).agg(F.count_distinct(run).alias("n_runs"))
    # only where a spread is asked for; no key's deviations are gathered
    several = off.join(runs.filter("n_runs >= 3").select(*keys), keys, "left_semi")
    spread = order_statistics(several, keys, "_off", MIDDLE).select(*keys, ((F.col("_below") + F.col("_above")) / 2).alias("mad"))
    return both.join(runs, keys).join(spread, keys, "left").select(*keys, place, width, "n_runs", "mad")


def reconcile_action(apex: Column, candidates: Column, expected: Column, tolerance: Column, half_width: Column) -> Column:
    """(action, place): keep the apex in tolerance, else the nearest candidate in tolerance (the lower on a tie), else force the expected place."""
    near = F.filter(candidates, lambda c: F.abs(c - expected) <= tolerance)
    nearest = F.array_min(F.transform(near, lambda c: F.struct(F.abs(c - expected).alias("d"), c.alias("at"))))
    keep = F.struct(F.lit("keep").alias("action"), apex.alias("place"), (apex - half_width).alias("low"), (apex + half_width).alias("high"))
    move = F.struct(F.lit("move").alias("action"), nearest["at"].alias("place"), (nearest["at"] - half_width).alias("low"), (nearest["at"] + half_width).alias("high"))
    force = F.struct(F.lit("force").alias("action"), expected.alias("place"), (expected - half_width).alias("low"), (expected + half_width).alias("high"))
    return F.when(F.abs(apex - expected) <= tolerance, keep).when(nearest.isNotNull(), move).otherwise(force)


def line_fit(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, slope, intercept, n by least squares; a constant x gives slope 0."""
    cov = F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)
    var = F.avg(F.col(x) * F.col(x)) - F.avg(x) * F.avg(x)
    slope = F.when(var > 1e-12, cov / var).otherwise(0.0)
    return rows.groupBy(*keys).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"), F.count("*").alias("n"))


def diverging_siblings(rows: DataFrame, keys: list[str], place: str, width: str, rank: list[Column]) -> DataFrame:
    """Rows farther from the best row of their ``keys`` than half its width (0.1 at least), with that row's place as ``target``."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(F.col(place).alias("target"), F.col(width).alias("_bw")), F.struct(*rank)).alias("_b"))
    joined = rows.join(best, keys).select(*rows.columns, "_b.*")
    return joined.filter(F.abs(F.col(place) - F.col("target")) > F.greatest(F.col("_bw") / 2, F.lit(0.1))).drop("_bw")
