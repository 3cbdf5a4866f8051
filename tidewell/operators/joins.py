"""Joins on ranges, bands and nearest values, as equi-joins on bins with the exact condition on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a list of places that is broadcast.
MOST_PLACES = 100_000


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, closed: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Rows of ``points`` with ``low <= at < high`` (or ``<= high``) of a row of ``ranges`` with equal ``keys``.

    Ranges stand under every bin of ``width`` that they touch, points under their own, so
    each pair meets once. Choose ``width`` near the usual length of a range.
    """
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = ranges.filter(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(bins))
    inside = (F.col(at) >= F.col(low)) & ((F.col(at) <= F.col(high)) if closed else (F.col(at) < F.col(high)))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(spread, [*(keys or []), "_bin"]).filter(inside).drop("_bin")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, tolerance: float) -> DataFrame:
    """Pairs of equal ``keys`` with ``|at - other| <= tolerance``; the left side stands under three bins of that width."""
    bins = F.explode(F.array(*[F.floor(F.col(at) / tolerance) + i for i in (-1, 0, 1)]))
    near = right.withColumn("_bin", F.floor(F.col(other) / tolerance))
    return left.withColumn("_bin", bins).join(near, [*keys, "_bin"]).filter(F.abs(F.col(at) - F.col(other)) <= tolerance).drop("_bin")


def nearest_in_band(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], at: str, other: str, value: str, tolerance: float) -> DataFrame:
    """Each left row with the ``value`` of the closest right row in the band, the lower one on a tie, 0 if there is none."""
    pairs = band_join(left.select(*dict.fromkeys([*left_id, *keys, at])), right.select(*keys, other, value), keys, at, other, tolerance)
    best = pairs.groupBy(*left_id).agg(F.min_by(F.struct(other, value), F.struct(F.abs(F.col(at) - F.col(other)), F.col(other))).alias("_b"))
    joined = left.join(best.select(*left_id, F.col(f"_b.{value}").alias("matched")), left_id, "left")
    return joined.withColumn("matched", F.coalesce("matched", F.lit(0.0)))


def most_intense_in_band(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], at: str, other: str, value: str, tolerance: float) -> DataFrame:
    """(left_id, other, value) of the most intense right row in the band, the lower one on a tie."""
    pairs = band_join(left.select(*dict.fromkeys([*left_id, *keys, at])), right.select(*keys, other, value), keys, at, other, tolerance)
    best = pairs.groupBy(*left_id).agg(F.max_by(F.struct(other, value), F.struct(F.col(value), -F.col(other))).alias("_b"))
    return best.select(*left_id, f"_b.{other}", f"_b.{value}")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, columns: list[str], max_distance: float | None = None) -> DataFrame:
    """Each left row with ``columns`` of the right row nearest in ``at``, the earlier one on a tie (null without any).

    Both sides are merged in order and the nearest before and after carried over: one
    shuffle on ``keys``, no pairs. Of right rows at one place the one with the smallest
    columns counts.
    """
    first = right.groupBy(*keys, F.col(other).alias("_at")).agg(F.min(F.struct(*columns)).alias("_r"))
    theirs = first.select(*keys, "_at", F.struct("_at", "_r").alias("_here"), F.lit(None).alias("_left"))
    ours = left.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(theirs.schema["_here"].dataType).alias("_here"), F.struct(*left.columns).alias("_left"))
    merged = ours.unionByName(theirs.withColumn("_left", F.lit(None).cast(ours.schema["_left"].dataType)))
    forth, back_again = (W.partitionBy(*keys).orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow) for o in (F.col("_at").asc(), F.col("_at").desc()))
    before = F.last("_here", ignorenulls=True).over(forth)
    after = F.last("_here", ignorenulls=True).over(back_again)
    placed = merged.withColumn("_b", before).withColumn("_a", after).filter(F.col("_left").isNotNull())
    back, ahead = F.col("_at") - F.col("_b._at"), F.col("_a._at") - F.col("_at")
    chosen = F.when(F.col("_a").isNull() | F.coalesce(back <= ahead, F.lit(False)), F.col("_b")).otherwise(F.col("_a"))
    chosen = placed.withColumn("_n", chosen)
    if max_distance is not None:
        chosen = chosen.withColumn("_n", F.when(F.abs(F.col("_n._at") - F.col("_at")) <= max_distance, F.col("_n")))
    return chosen.select("_left.*", F.col("_n._at").alias(other), *[F.col(f"_n._r.{c}").alias(c) for c in columns])


def gaps(present: DataFrame, subjects: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """Every subject at every place where it isn't present. ``places`` has MOST_PLACES rows at most (else an error), so it can be broadcast."""
    if places.limit(MOST_PLACES + 1).count() > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} places")
    return subjects.crossJoin(F.broadcast(places)).join(present.select(*keys).distinct(), keys, "left_anti")


def with_default(left: DataFrame, right: DataFrame, keys: list[str], column: str, default: Column) -> DataFrame:
    """``left`` with ``column`` of the matching right row, or the default."""
    return left.join(right.select(*keys, column), keys, "left").withColumn(column, F.coalesce(column, default))
