"""Calibration curves between two scales, one fit per ``keys`` (a run), applied by a join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import kernels
from tidewell.operators import stats
from tidewell.storage import stored

#: Knots of a curve at most. A run of more points has its knots at the means of so many even ranges of x.
MAX_KNOTS = 500
#: Robust passes after the first fit.
PASSES = 2


def fit_curves(points: DataFrame, keys: list[str], x: str, y: str, bandwidth: float = 0.3, least: int = 20, passes: int = PASSES) -> DataFrame:
    """keys, knots, fitted, residuals (mean absolute one at each knot), sd, mad, n: robust local regression of y on x.

    All points weigh in every pass, and residuals, their spread and their median are those
    of the points. Points come to a fit as weighted means of their knot's range: each point
    by the weight that the curve of the pass before gives it (bisquare at six median absolute
    residuals). A run of up to MAX_KNOTS points has a knot for each place.
    """
    kinds = dict(points.dtypes)
    rows = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    ends = rows.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    cell = F.when(F.col("_lo") == F.col("_hi"), 0.0).when(F.col("_n") > MAX_KNOTS, F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * MAX_KNOTS), F.lit(MAX_KNOTS - 1)).cast("double")).otherwise(F.col("_x"))
    rows = stored(rows.join(ends, keys).withColumn("_c", cell), "points")
    means = rows.groupBy(*keys, "_n", "_c").agg(F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.count("*").alias("m"), F.count("*").cast("double").alias("w"))

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["mx", "my"])
        at, values, rows_at, weights = (part[c].to_numpy(float) for c in ("mx", "my", "m", "w"))
        fitted = kernels.local_lines(at, values, rows_at, weights, bandwidth)
        return pd.DataFrame([(*key, int(part["_n"].iloc[0]), at, fitted, part["_c"].to_numpy(float))], columns=[*keys, "n", "knots", "fitted", "cells"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, knots array<double>, fitted array<double>, cells array<double>"
    for n in range(passes + 1):
        curves = stored(means.groupBy(*keys).applyInPandas(one, schema), f"curves_{n}")
        value = F.col("_k") + (F.col("_x") - F.col("_at")) * F.when(F.col("_x") < F.col("_at"), F.col("_before")).otherwise(F.col("_after"))
        off = stored(rows.join(_slopes(curves, keys), [*keys, "_c"]).withColumn("_a", F.abs(F.col("_y") - value)).select(*rows.columns, "_a"), f"residuals_{n}")
        middle = stats.order_statistics(off, keys, "_a", stats.MIDDLE).select(*keys, ((F.col("_below") + F.col("_above")) / 2).alias("mad"))
        if n < passes:
            scale = F.col("mad") * 6
            near = F.when(scale > 0, F.pow(1 - F.pow(F.least(F.col("_a") / scale, F.lit(1.0)), F.lit(2)), F.lit(2))).otherwise(1.0)
            weighted = off.join(middle, keys).withColumn("_w", near)
            mean = lambda c: F.coalesce(F.sum(F.col("_w") * F.col(c)) / F.nullif(F.sum("_w"), F.lit(0.0)), F.avg(c))
            means = weighted.groupBy(*keys, "_n", "_c").agg(mean("_x").alias("mx"), mean("_y").alias("my"), F.count("*").alias("m"), F.sum("_w").alias("w"))
    spread = off.groupBy(*keys).agg(F.coalesce(F.stddev_samp("_a"), F.lit(0.0)).alias("sd"))
    # knots move a little with the weights, so a range's residuals go to the knot of its rank
    profile = off.groupBy(*keys, "_c").agg(F.avg("_a").alias("r")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", "r"))), lambda v: v.r).alias("residuals"))  # MAX_KNOTS at most
    return curves.join(profile, keys).join(spread, keys).join(middle, keys).select(*keys, "knots", "fitted", "residuals", "sd", "mad", "n")


def _slopes(curves: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _c (cell), and its knot: place (_at), value (_k) and the slopes before and after it, those of the ends going on beyond them."""
    each = curves.select(*keys, F.posexplode(F.arrays_zip("cells", "knots", "fitted")).alias("_i", "_z")).select(*keys, "_i", F.col("_z.cells").alias("_c"), F.col("_z.knots").alias("_at"), F.col("_z.fitted").alias("_k"))
    w = W.partitionBy(*keys).orderBy("_i")  # MAX_KNOTS rows at most
    before = (F.col("_k") - F.lag("_k").over(w)) / (F.col("_at") - F.lag("_at").over(w))
    after = (F.lead("_k").over(w) - F.col("_k")) / (F.lead("_at").over(w) - F.col("_at"))
    both = each.withColumns({"_b": before, "_a": after})
    return both.select(*keys, "_c", "_at", "_k", F.coalesce("_b", "_a", F.lit(0.0)).alias("_before"), F.coalesce("_a", "_b", F.lit(0.0)).alias("_after"))


def place(sorted_values: Column, value: Column, field: str | None = None, equal: bool = False) -> Column:
    """How many of the sorted values (or their ``field``) are below ``value`` (with ``equal``: or equal to it), by halving."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        at = F.get(sorted_values, mid)
        at = at[field] if field else at
        right = (at <= value) if equal else (at < value)
        return F.when(s.lo >= s.hi, s).when(right, F.struct((mid + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), mid.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.size(sorted_values).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_values) + 1)).cast("int"))
    return F.aggregate(steps, start, halve).lo


def apply_curves(df: DataFrame, curves: DataFrame, keys: list[str], x: str, name: str, inverse: bool = False) -> DataFrame:
    """Adds ``name``: the curve's value at x, its outer slopes beyond the knots; with ``inverse`` the place that has the value x.

    A curve that isn't monotone has no inverse; the knot whose value is nearest stands for it
    then. The places around x are found in the sorted knots on the JVM; no Python runs.
    """
    at, to = ("fitted", "knots") if inverse else ("knots", "fitted")
    joined = df.join(curves.select(*keys, F.col(at).alias("_at"), F.col(to).alias("_to")), keys)
    i = F.greatest(F.lit(0), F.least(place(F.col("_at"), F.col(x)) - 1, F.size("_at") - 2))
    joined = joined.withColumn("_i", i)
    a, b = F.get("_at", F.col("_i")), F.get("_at", F.col("_i") + 1)
    c, d = F.get("_to", F.col("_i")), F.get("_to", F.col("_i") + 1)
    value = F.when(F.size("_at") == 1, F.get("_to", F.lit(0))).when(b == a, (c + d) / 2).otherwise(c + (d - c) / (b - a) * (F.col(x) - a))
    if inverse:
        rising = F.array_sort("_at") == F.col("_at")
        off = F.transform("_at", lambda v, j: F.struct(F.abs(v - F.col(x)).alias("off"), j.alias("j")))
        value = F.when(rising, value).otherwise(F.get("_to", F.array_min(off).j))
    return joined.withColumn(name, value).drop("_at", "_to", "_i")


def local_tolerance(df: DataFrame, curves: DataFrame, keys: list[str], x: str, factor: float, least: float) -> DataFrame:
    """Adds ``tolerance``: factor times the mean of the five absolute residuals around the nearest knot below, ``least`` at least."""
    joined = df.join(curves.select(*keys, F.col("knots").alias("_k"), F.col("residuals").alias("_r")), keys)
    i = F.greatest(F.lit(1), F.least(place(F.col("_k"), F.col(x), equal=True), F.size("_k")))
    near = F.slice("_r", F.greatest(i - 2, F.lit(1)), F.lit(5))
    mean = F.aggregate(near, F.lit(0.0), lambda s, v: s + v) / F.size(near)
    return joined.withColumn("tolerance", F.greatest(mean * factor, F.lit(float(least)))).drop("_k", "_r")
