"""How far the peak of a series reaches: limits, half widths, background, all by windows outward from the apex.

A series is the rows of equal ``keys`` in the order of ``order``; ``y`` is its value. Its
apex is the highest row, the last one on a tie. Rows are numbered from 0 along the series,
and looked at outward from the apex on each side; the apex itself belongs to both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def outward(df: DataFrame, keys: list[str], order: list[str], y: str, x: str | None = None) -> DataFrame:
    """keys, side (-1 or 1), away (steps from the apex), i, y, x, top (the apex's y), top_i, top_x, n."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    placed = df.select(*keys, place.alias("i"), F.col(y).cast("double").alias("y"), (F.col(x).cast("double") if x else place.cast("double")).alias("x"))
    tops = placed.groupBy(*keys).agg(F.max(F.struct("y", "i", "x")).alias("t"), F.count("*").alias("n"))
    sides = placed.join(tops, keys).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("away", (F.col("i") - F.col("t.i")) * F.col("side"))
    return sides.filter("away >= 0").select(*keys, "side", "away", "i", "y", "x", F.col("t.y").alias("top"), F.col("t.i").alias("top_i"), F.col("t.x").alias("top_x"), "n")


def _stops(rows: DataFrame, keys: list[str], stop: Column) -> DataFrame:
    """keys, left, right: where each side stops first, by ``stop`` (a place, or null to go on); the series' ends if it doesn't."""
    first = F.min(F.when(stop.isNotNull(), F.struct("away", stop.alias("at")))).alias("s")
    sides = rows.groupBy(*keys, "side", "n").agg(first)
    left = F.max(F.when(F.col("side") == -1, F.coalesce("s.at", F.lit(0)))).alias("left")
    right = F.max(F.when(F.col("side") == 1, F.coalesce(F.col("s.at"), F.col("n") - 1))).cast("int").alias("right")
    return sides.groupBy(*keys).agg(left, right)


def _valleys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``valley`` and ``valley_i``: the lowest row up to this one, the nearest to the apex on a tie, and the same before this row."""
    w = W.partitionBy(*keys, "side").orderBy("away")
    low = F.min(F.struct("y", "away", "i"))
    up = rows.withColumn("_v", low.over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_b", low.over(w.rowsBetween(W.unboundedPreceding, -1)))
    return up.select(*rows.columns, F.col("_v.y").alias("valley"), F.col("_v.i").alias("valley_i"), F.col("_b.y").alias("before"), F.col("_b.i").alias("before_i"))


def limits(df: DataFrame, keys: list[str], order: list[str], y: str, share: float = 0.05) -> DataFrame:
    """keys, left, right: down from the apex to the first row below ``share`` of it, or to a valley.

    A valley ends the peak where it is below half of the apex and the row after it is more than twice as high.
    """
    rows = _valleys(outward(df, keys, order, y), keys)
    rising = (F.col("y") >= F.col("before")) & (F.col("before") < F.col("top") / 2) & (F.col("before") < F.col("y") / 2)
    below = F.col("y") < F.col("top") * share
    return _stops(rows, keys, F.when(F.col("away") > 0, F.when(rising, F.col("before_i")).when(below, F.col("i"))))


def isolated(df: DataFrame, keys: list[str], order: list[str], y: str, rise: float = 0.05) -> DataFrame:
    """keys, left, right: out to the lowest row before the series rises by over ``rise`` of the apex; under three rows, all of them."""
    rows = _valleys(outward(df, keys, order, y), keys)
    rises = (F.col("n") >= 3) & (F.col("away") > 0) & (F.col("y") - F.col("valley") > F.col("top") * rise)
    return _stops(rows, keys, F.when(rises, F.col("valley_i")))


def half_widths(df: DataFrame, keys: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """keys, left_width, right_width: from the apex to where the series falls below half of it, by linear interpolation.

    A side that doesn't fall so far is as wide as the other; series that never do, or whose apex isn't positive, have none.
    """
    rows = outward(df, keys, order, y, x)
    w = W.partitionBy(*keys, "side").orderBy("away")
    half, inner, inner_x = F.col("top") / 2, F.lag("y").over(w), F.lag("x").over(w)
    crossing = inner_x + (inner - half) / F.nullif(inner - F.col("y"), F.lit(0.0)) * (F.col("x") - inner_x)
    rows = rows.withColumn("_at", F.when((inner >= half) & (F.col("y") < half), F.abs(crossing - F.col("top_x")))).filter("top > 0")
    found = rows.groupBy(*keys).agg(*[F.min(F.when((F.col("side") == s) & F.col("_at").isNotNull(), F.struct("away", "_at"))).alias(n) for n, s in (("l", -1), ("r", 1))])
    left, right = (F.when(F.col(f"{n}._at") > 0, F.col(f"{n}._at")) for n in "lr")
    both = found.select(*keys, left.alias("l"), right.alias("r")).filter("l IS NOT NULL OR r IS NOT NULL")
    return both.select(*keys, F.coalesce("l", "r").alias("left_width"), F.coalesce("r", "l").alias("right_width"))


def background(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, nearest: int = 5, least_rows: int = 10, least: int = 4) -> DataFrame:
    """keys, mean, sd (population), n_points of the ``nearest`` rows on each side beyond 1.96 standard deviations of the peak's width.

    None for series of under ``least_rows`` rows, without a width, or with under ``least`` such rows.
    """
    widths = half_widths(df, keys, order, x, y).select(*keys, ((F.col("left_width") + F.col("right_width")) / 2.355 * 1.96).alias("_reach"))
    rows = outward(df, keys, order, y, x).filter(F.col("n") >= least_rows).join(widths, keys)
    beyond = rows.filter((F.col("away") > 0) & (F.abs(F.col("x") - F.col("top_x")) > F.col("_reach")))
    nth = F.row_number().over(W.partitionBy(*keys, "side").orderBy("away"))
    used = beyond.withColumn("_nth", nth).filter(F.col("_nth") <= nearest)
    found = used.groupBy(*keys).agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"), F.count("*").alias("n_points"))
    return found.filter(F.col("n_points") >= least)


def best_near(peaks: DataFrame, keys: list[str], place: str, height: str, expected: Column, tolerance: float) -> DataFrame:
    """The highest peak of each ``keys`` within ``tolerance`` of the expected place, the first on a tie."""
    near = peaks.filter(F.abs(F.col(place) - expected) <= tolerance)
    first = W.partitionBy(*keys).orderBy(F.col(height).desc(), place)
    return near.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
