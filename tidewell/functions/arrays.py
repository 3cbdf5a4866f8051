"""Column functions over arrays: similarity, correlation, matching, ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [0, 1]; 0 if either has no length."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms < 1e-30, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norms)))


def root_cosine(a: Column, b: Column) -> Column:
    """Cosine of the square roots, which weighs large values less."""
    root = lambda v: F.transform(v, lambda x: F.sqrt(F.greatest(x.cast("double"), F.lit(0.0))))
    return cosine(root(a), root(b))


def weighted_root_cosine(a: Column, b: Column, at: Column) -> Column:
    """Cosine of square roots times the square of the place."""
    weigh = lambda v: F.zip_with(v, at, lambda x, m: F.sqrt(F.greatest(x.cast("double"), F.lit(0.0))) * m * m)
    return cosine(weigh(a), weigh(b))


def pearson(a: Column, b: Column) -> Column:
    """Correlation; 0, not null, if either is constant."""

    def of(v: Column) -> Column:
        ma, mb = total(v.a) / F.size(v.a), total(v.b) / F.size(v.b)
        return let(
            F.struct(F.transform(v.a, lambda x: x - ma).alias("a"), F.transform(v.b, lambda x: x - mb).alias("b")),
            lambda c: F.when(F.sqrt(dot(c.a, c.a) * dot(c.b, c.b)) < 1e-30, 0.0).otherwise(dot(c.a, c.b) / F.sqrt(dot(c.a, c.a) * dot(c.b, c.b))),
        )

    both = F.struct(F.transform(a, lambda x: x.cast("double")).alias("a"), F.transform(b, lambda x: x.cast("double")).alias("b"))
    return F.when(F.size(a) > 0, let(both, of)).otherwise(0.0)


def ranks(values: Column) -> Column:
    """Average ranks from 1, equal values sharing theirs."""
    return F.transform(values, lambda x: F.size(F.filter(values, lambda y: y < x)) + (F.size(F.filter(values, lambda y: y == x)) + 1) / 2.0)


def spearman(a: Column, b: Column) -> Column:
    return pearson(ranks(a), ranks(b))


def top_indices(values: Column, n: int) -> Column:
    """Places (from 0) of the ``n`` largest values, earlier places first on a tie."""
    placed = F.transform(values, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda s: s.i)


def tolerance_width(at: Column, tolerance: float, unit: str) -> Column:
    """Half width of a tolerance in ``ppm`` of the expected place, or ``absolute``."""
    if unit not in ("ppm", "absolute"):
        raise ValueError(f"unit is ppm or absolute, not {unit!r}")
    return at * (tolerance / 1e6) if unit == "ppm" else F.lit(float(tolerance))


def matched(expected: Column, observed: Column, tolerance: float, unit: str) -> Column:
    """Those of ``expected`` with an observed place within tolerance."""
    return F.filter(expected, lambda e: F.exists(observed, lambda o: F.abs(o - e) <= tolerance_width(e, tolerance, unit)))


def has_top_match(expected: Column, weights: Column, observed: Column, tolerance: float, unit: str, n: int = 6, least: int = 2) -> Column:
    """Whether ``least`` of the ``n`` heaviest expected places (one, if there is one only) are observed; true if either side is empty."""
    top = F.transform(top_indices(weights, n), lambda i: F.get(expected, i))
    need = F.least(F.lit(least), F.size(expected))
    return (F.size(expected) == 0) | (F.size(observed) == 0) | (F.size(matched(top, observed, tolerance, unit)) >= need)


def closest_error(expected: Column, observed: Column, tolerance: float, unit: str) -> Column:
    """Signed error of the closest observed place for each expected place that has one within tolerance; the lower one on a tie."""

    def nearest(e: Column) -> Column:
        near = F.filter(observed, lambda o: F.abs(o - e) <= tolerance_width(e, tolerance, unit))
        return F.array_min(F.transform(near, lambda o: F.struct(F.abs(o - e).alias("d"), o.alias("o")))).o - e

    return F.filter(F.transform(expected, nearest), lambda x: x.isNotNull())


def longest_run(ordinals: Column) -> Column:
    """Length of the longest run of consecutive integers among them."""
    ordered = F.array_sort(F.array_distinct(ordinals))
    step = lambda a, x: F.struct(x.alias("at"), F.when(x == a.at + 1, a.n + 1).otherwise(1).alias("n"), F.greatest(a.best, F.when(x == a.at + 1, a.n + 1).otherwise(1)).alias("best"))
    start = F.struct(F.lit(-2).cast("int").alias("at"), F.lit(0).alias("n"), F.lit(0).alias("best"))
    return F.aggregate(F.transform(ordered, lambda x: x.cast("int")), start, step).best


def savitzky_golay(values: Column) -> Column:
    """Five-point quadratic smoothing of an array, 0 at least; two values at each end stay."""
    at = lambda i, k: F.get(values, i + k).cast("double")
    inner = lambda i: F.greatest(F.lit(0.0), (-3 * at(i, -2) + 12 * at(i, -1) + 17 * at(i, 0) + 12 * at(i, 1) - 3 * at(i, 2)) / 35.0)
    return F.transform(values, lambda x, i: F.when((i < 2) | (i >= F.size(values) - 2), x.cast("double")).otherwise(inner(i)))


def isotope_cosine(observed: Column, expected: Column) -> Column:
    """Observed envelope from one place below the first peak, against the expected one with 0 there; null without signal."""
    shifted = F.concat(F.array(F.lit(0.0)), F.slice(expected, 1, 4))
    return F.when(total(observed) > 0, cosine(observed, shifted))


def isotope_places(mz: Column, charge: Column, spacing: float = 1.002868) -> Column:
    """Five places of an envelope, from one below."""
    return F.transform(F.sequence(F.lit(-1), F.lit(3)), lambda k: mz + k * spacing / charge)


def bin_of(mz: Column, width: float, offset: float, top: float = 2000.0) -> Column:
    """Bin number, null outside (0, top)."""
    return F.when((mz >= 0) & (mz < top), (mz / width + (1.0 - offset)).cast("int"))


def calibrated(mz: Column, mean: Column, unit: str) -> Column:
    """Observed places without the mean error."""
    return mz - mz * mean / 1e6 if unit == "ppm" else mz - mean


def calibrated_tolerance(sd: Column, base: float, unit: str, n: Column) -> Column:
    """Three standard deviations, 1 ppm or 0.05 at least; the base without any observation."""
    return F.when(n > 0, F.greatest(sd * 3, F.lit(1.0 if unit == "ppm" else 0.05))).otherwise(F.lit(float(base)))
