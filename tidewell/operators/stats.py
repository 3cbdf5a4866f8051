"""Robust statistics, calibration summaries, sampling and folds."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import ranges
from tidewell.storage import stored


#: Distinct values of a key up to which one task adds up its weights in the order of the values.
MOST_VALUES = 100_000


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, most: int = MOST_VALUES) -> DataFrame:
    """keys, median: the least value at which half of the weight is reached; nulls are above all values.

    Weights are added up per distinct value first, then one by one in the order of the values, the whole as well as the
    parts, so where a key's rows lie doesn't decide whether a half is reached. Only keys of more than ``most`` values are
    added up over ranges of values.
    """
    each = stored(df.groupBy(*keys, value).agg(F.sum(weight).alias("_w")), "weights")
    order, median = F.col(value).asc_nulls_last(), F.min(value).alias("median")
    key = W.partitionBy(*keys).orderBy(order)
    sums = {"_upto": F.sum("_w").over(key.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_w").over(key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))}
    reached = lambda rows: rows.filter(F.col("_upto") * 2 >= F.col("_all")).groupBy(*keys).agg(median)
    large = stored(each.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_w").alias("_all")).filter(F.col("_n") > most).drop("_n"), "large_keys")
    if large.isEmpty():
        return reached(each.withColumns(sums))
    rows = ranges.with_running(ranges.ranged(ranges.matched(each, large.select(*keys), keys, "left_semi"), keys, [order]), keys, [order], {"_upto": F.col("_w")})
    return reached(ranges.matched(each, large.select(*keys), keys, "left_anti").withColumns(sums)).unionByName(reached(ranges.matched(rows, large, keys)))


def sorted_values(value: str) -> Column:
    return F.sort_array(F.collect_list(value))


def middle(values: Column) -> Column:
    """Of a sorted array, the middle value or the mean of the two middle ones."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2.0


def nearest_rank(n: Column, share: float) -> Column:
    """The place of a percentile among n sorted values: round(share * (n - 1))."""
    return F.round(F.lit(share) * (n - 1)).cast("long")


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]], bins: int = 4096) -> DataFrame:
    """keys and, for each name, the value at place ``places[name](n)`` (from 0) of the key's n sorted values; nulls don't count.

    Exact, without a sort of all values and without an array of them: counts of ``bins`` even
    ranges, shared by all places, say in which range a place is; only the rows of such ranges
    are divided again, and only those of the ranges within are counted by value.
    """
    rows = stored(df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL"), "values")  # read several times
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    even = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    inside = ranges.matched(rows, ends.drop("_n"), keys).select(*keys, "_v", even.alias("_b0"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), f(F.col("_n")).cast("long").alias("_at")) for name, f in places.items()]))
    asked = ends.select(*keys, each.alias("_x")).select(*keys, "_x._name", "_x._at")
    within = list(keys)
    for level, part in enumerate(("_b0", "_b1", "_v")):
        counts = inside.groupBy(*within, part).agg(F.count("*").alias("_c"), *([F.min("_v").alias("_lo"), F.max("_v").alias("_hi")] if part != "_v" else []))
        upto = W.partitionBy(*within).orderBy(part).rowsBetween(W.unboundedPreceding, 0)
        running = counts.withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
        held = ranges.matched(asked, running, within).filter(F.col("_at").between(F.col("_before"), F.col("_before") + F.col("_c") - 1))
        within = [*within, part]
        if part != "_v":
            asked = held.select(*within, "_name", (F.col("_at") - F.col("_before")).alias("_at"))
            open_ranges = held.select(*within, "_lo", "_hi").distinct()  # a row per key and place at most
            inside = ranges.matched(inside, open_ranges, within).select(*within, "_v", *([even.alias("_b1")] if level == 0 else []))
    return held.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])


#: Places of the two middle values; their mean is the median.
MIDDLE = {"_below": lambda n: F.floor((n - 1) / 2), "_above": lambda n: F.floor(n / 2)}


def clipped_mad(df: DataFrame, keys: list[str], residual: str, clip: float | Column, least: int = 20) -> DataFrame:
    """keys, mad: the upper median of absolute residuals up to ``clip``, or of all if fewer than ``least`` are."""
    each = df.select(*keys, F.abs(residual).alias("_a"), (F.abs(residual) <= clip).alias("_in"))
    few = each.groupBy(*keys).agg((F.count(F.when(F.col("_in"), 1)) < least).alias("_few"))
    used = ranges.matched(each, few, keys).filter(F.col("_few") | F.col("_in"))
    return order_statistics(used, keys, "_a", {"mad": lambda n: F.floor(n / 2)})


def calibration_summary(df: DataFrame, keys: list[str], error: str) -> DataFrame:
    """keys, n, mean, median, sd (sample), tolerance: |mean| + 3 sd."""
    sd = F.coalesce(F.stddev_samp(error), F.lit(0.0))
    moments = df.groupBy(*keys).agg(F.count(error).alias("n"), F.avg(error).alias("mean"), sd.alias("sd"), (F.abs(F.avg(error)) + 3 * sd).alias("tolerance"))
    middle = order_statistics(df, keys, error, MIDDLE).select(*keys, ((F.col("_below") + F.col("_above")) / 2).alias("median"))
    return ranges.matched(moments, middle, keys, "left").select(*keys, "n", "mean", "median", "sd", "tolerance")


def histogram(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """keys, bin, n: bins of ``width`` from the group's least value; the last one includes its upper end, empty ones count 0."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    ends = ends.withColumn("_bins", F.greatest(F.ceil((F.col("_hi") - F.col("_lo")) / width), F.lit(1)).cast("int"))
    placed = df.join(ends, keys).withColumn("bin", F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.col("_bins") - 1).cast("int"))
    counts = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    every = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)).alias("bin"))
    return every.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def fit_quality(df: DataFrame, keys: list[str], observed: str, fitted: str) -> DataFrame:
    """keys, n, sd, mean_abs, largest, r2, p20, p80, mad of the residuals; percentiles are nearest-rank ones of absolute residuals."""
    r = F.col(observed) - F.col(fitted)
    each = df.withColumn("_r", r).withColumn("_a", F.abs(r))
    out = each.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.stddev_samp("_r").alias("sd"),
        F.avg("_a").alias("mean_abs"),
        F.max("_a").alias("largest"),
        F.sum(F.col("_r") * F.col("_r")).alias("_ss"),
        (F.var_pop(observed) * F.count("*")).alias("_tot"),
    )
    places = {"p20": lambda n: nearest_rank(n, 0.2), "p80": lambda n: nearest_rank(n, 0.8), **MIDDLE}
    r2 = F.when(F.col("_tot") > 0, 1 - F.col("_ss") / F.col("_tot")).otherwise(0.0)
    return ranges.matched(out, order_statistics(each, keys, "_a", places), keys).select(*keys, "n", "sd", "mean_abs", "largest", r2.alias("r2"), "p20", "p80", ((F.col("_below") + F.col("_above")) / 2).alias("mad"))


def rank_auc(df: DataFrame, keys: list[str], value: str, positive: str) -> DataFrame:
    """keys, auc: the chance that a positive row's value is above a negative one's, half for ties (0.5 without both).

    Counts per distinct value first; ties have their average rank.
    """
    each = df.groupBy(*keys, value).agg(F.sum(F.col(positive).cast("int")).alias("p"), F.count("*").alias("n"))
    rows = ranges.with_running(ranges.ranged(each, keys, [F.col(value)]), keys, [F.col(value)], {"_upto": F.col("n") - F.col("p")})
    placed = rows.withColumn("_below", F.col("_upto") - (F.col("n") - F.col("p")))
    won = F.sum(F.col("p") * F.col("_below") + F.col("p") * (F.col("n") - F.col("p")) / 2.0)
    total = F.sum("p") * F.sum(F.col("n") - F.col("p"))
    return placed.groupBy(*keys).agg(F.when(total > 0, won / total).otherwise(0.5).alias("auc"))


def best_separating(df: DataFrame, features: list[str], positive: str) -> DataFrame:
    """(feature, auc) of the feature whose AUC is farthest from 0.5, the first by name on a tie. One pass for all features."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")
    long = df.select(F.col(positive).alias("positive"), pairs).select("positive", "x.feature", "x.value")
    return rank_auc(long, ["feature"], "value", "positive").orderBy(F.abs(F.col("auc") - 0.5).desc(), "feature").limit(1)


def standardized(df: DataFrame, features: list[str]) -> DataFrame:
    """Features less their mean, by their population standard deviation (1 if that is below 1e-12)."""
    stats = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    sd = lambda f: F.when(F.col(f"_s_{f}") < 1e-12, 1.0).otherwise(F.col(f"_s_{f}"))
    joined = df.crossJoin(F.broadcast(stats))  # one row
    return joined.select(*[c for c in df.columns if c not in features], *[((F.col(f) - F.col(f"_m_{f}")) / sd(f)).alias(f) for f in features])


def folds(df: DataFrame, group: str, n: int = 3) -> DataFrame:
    """(group, fold): ranks of the sorted distinct groups modulo ``n``, so rows of a group stay together."""
    from tidewell.operators.dedup import renumbered

    return renumbered(df.select(group).distinct(), [group], "_rank").select(group, F.pmod("_rank", F.lit(n)).cast("int").alias("fold"))


def stratified_sample(df: DataFrame, x: str, y: str, order: str, size: int) -> DataFrame:
    """About ``size`` rows spread over a grid: ceil(sqrt(size / 2)) bins (5 at least) on each axis, as many rows of each cell, the first by ``order``.

    Everything if there are no more rows than that.
    """
    bins = max(5, -(-int((size / 2) ** 0.5 * 1000) // 1000))
    ends = df.agg(F.count("*").alias("_n"), *[f(c).alias(f"_{k}_{c}") for c in (x, y) for k, f in (("lo", F.min), ("hi", F.max))])
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"_lo_{c}")) / F.greatest((F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / bins, F.lit(1e-12))), F.lit(bins - 1))
    placed = df.crossJoin(F.broadcast(ends)).withColumn("_x", cell(x)).withColumn("_y", cell(y))
    per_cell = -(-size // (bins * bins))
    nth = F.row_number().over(W.partitionBy("_x", "_y").orderBy(order))
    return placed.withColumn("_nth", nth).filter((F.col("_n") <= size) | (F.col("_nth") <= per_cell)).select(*df.columns)


def stride_sample(df: DataFrame, x: str, y: str, order: str, size: int, seed: int = 0) -> DataFrame:
    """Exactly ``size`` rows of ``df`` (all, if there are no more) spread over a grid of ceil(sqrt(size) / 2) bins, 5 at least, on each axis.

    Each cell gives an even share of the sample, taken in strides through its rows by ``order`` from a place that ``seed``
    gives. What thin cells leave open is filled by one more row of each cell in turn, then a second, and so on. Places in
    cells and in the turns are running sums in two steps, so neither a crowded cell nor the whole is one task's.
    """
    bins = max(5, ceil(size**0.5 / 2))
    ends = df.agg(F.count("*").alias("_n"), *[f(c).cast("double").alias(f"_{k}_{c}") for c in (x, y) for k, f in (("lo", F.min), ("hi", F.max))])
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"_lo_{c}")) / (F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(1e-6)) / bins)), F.lit(bins - 1))
    placed = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    rows = ranges.ranged(placed.withColumn("_x", cell(x)).withColumn("_y", cell(y)), ["_x", "_y"], [F.col(order)], "cells")
    counted = rows.groupBy("_x", "_y").agg(F.count("*").alias("_cell"))  # bins * bins rows at most
    cells = counted.crossJoin(F.broadcast(counted.agg(F.count("*").alias("_cells"))))
    share = F.least(F.col("_cell"), F.greatest(F.floor(F.lit(size) / F.col("_cells")), F.lit(1))).cast("long")
    cells = cells.select("_x", "_y", "_cell", share.alias("_share"), F.greatest(F.floor(F.col("_cell") / share), F.lit(1)).alias("_stride"))
    numbered = ranges.matched(ranges.with_running(rows, ["_x", "_y"], [F.col(order)], {"_at": F.lit(1)}), cells, ["_x", "_y"])
    step = F.pmod(F.col("_at") - 1 - F.pmod(F.lit(seed), F.col("_cell")), F.col("_cell"))
    turn = F.when((step % F.col("_stride") == 0) & (step / F.col("_stride") < F.col("_share")), F.floor(step / F.col("_stride")))
    numbered = numbered.withColumn("_turn", turn)
    rest = ranges.with_running(numbered, ["_x", "_y"], [F.col(order)], {"_left": F.when(F.col("_turn").isNull(), 1).otherwise(0)})
    by = [F.col("_turn").isNull().cast("int"), F.coalesce("_turn", "_left"), F.col("_x"), F.col("_y")]
    turns = rest.withColumns({f"_o{i}": c.cast("long") for i, c in enumerate(by)}).drop(ranges.PART)
    order_by = [F.col(f"_o{i}") for i in range(4)]
    ranked = ranges.with_running(ranges.ranged(turns, [], order_by, "turns"), [], order_by, {"_rank": F.lit(1)})
    return ranked.filter(F.col("_rank") <= size).select(*df.columns)
