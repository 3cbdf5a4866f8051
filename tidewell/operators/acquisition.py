"""What measurements of a run have in common: acquisition cycles, overlapping detections, isotope envelopes, match scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.arrays import let, tolerance_width
from tidewell.operators import ranges
from tidewell.operators.joins import band_join
from tidewell.operators.local_fit import place as at_place
from tidewell.storage import stored

#: Shares of the heavier isotopes of C, H, N (one more), O (one, two more) and S (one, two more).
HEAVY = {"c": 0.0107, "h": 0.000115, "n": 0.00364}
HEAVY_TWO = {"o": (0.00038, 0.00205), "s": (0.0075, 0.0425)}


def first_cycle(scans: DataFrame, keys: list[str], scan: str, center: str) -> DataFrame:
    """keys, n_windows, least, most: the centers up to the first that comes again."""
    seen = F.row_number().over(W.partitionBy(*keys, center).orderBy(scan))
    marked = scans.withColumn("_seen", seen)
    again = marked.groupBy(*keys).agg(F.min(F.when(F.col("_seen") == 2, F.col(scan))).alias("_again"))
    cycle = marked.join(again, keys).filter(F.col("_again").isNull() | (F.col(scan) < F.col("_again")))
    return cycle.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.min(center).alias("least"), F.max(center).alias("most"))


def log_factorial(n: Column) -> Column:
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1).cast("long"), n.cast("long")), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))).otherwise(0.0)


def hyperscore(n_b: Column, n_y: Column, log_intensity: Column) -> Column:
    """ln(b!) + ln(y!) + the sum of ln(1 + intensity)."""
    return log_factorial(n_b) + log_factorial(n_y) + log_intensity


def _convolved(a: Column, b: Column) -> Column:
    def sums(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0.0), lambda s, j: s + F.get(v.a, j) * F.get(v.b, i - j)))

    return let(F.struct(a.alias("a"), b.alias("b")), sums)  # both bound, or each level would compute the ones below again and again


def _heavy(n: Column, p: float) -> Column:
    """Chances of 0 to 4 heavy atoms of n."""
    first, odds = F.pow(F.lit(1 - p), n), p / (1 - p)
    chances = [first]
    for k in range(1, 5):
        chances.append(F.greatest(chances[-1] * (n - (k - 1)) / k * odds, F.lit(0.0)))
    return F.array(*chances)


def _heavy_two(n: Column, one: float, two: float) -> Column:
    """The same for an element with isotopes one and two heavier: a heavy atom is the second kind with a fixed chance."""
    heavy, share = one + two, two / (one + two)
    mixes = [[0.0] * 5 for _ in range(5)]
    from math import comb

    for atoms in range(5):
        for pairs in range(atoms + 1):
            if atoms + pairs <= 4:
                mixes[atoms + pairs][atoms] += comb(atoms, pairs) * share**pairs * (1 - share) ** (atoms - pairs)
    table = F.array(*[F.array(*map(F.lit, m)) for m in mixes])
    return let(_heavy(n, heavy), lambda k: F.transform(table, lambda mix: F.aggregate(F.zip_with(k, mix, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)))


def isotope_distribution(atoms: Column) -> Column:
    """Shares of the first five masses for (c, h, n, o, s), together 1."""
    parts = [_heavy(atoms[e], p) for e, p in HEAVY.items()] + [_heavy_two(atoms[e], *p) for e, p in HEAVY_TWO.items()]
    out = parts[0]
    for p in parts[1:]:
        out = _convolved(out, p)
    return let(out, lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), lambda whole: F.transform(v, lambda x: x / whole)))


def n_overlapping(a: Column, b: Column, tolerance: float, unit: str) -> Column:
    """How many places of ``a`` have one of ``b`` within tolerance of them; ``b`` is sorted once and searched by halving."""

    def count(s: Column) -> Column:
        reach = lambda x: tolerance_width(x, tolerance, unit)
        return F.size(F.filter(s.a, lambda x: at_place(s.b, x - reach(x)) < at_place(s.b, x + reach(x), equal=True)))

    return F.when(F.size(a) * F.size(b) > 0, let(F.struct(a.alias("a"), F.array_sort(b).alias("b")), count)).otherwise(0)


#: Rows of a key up to which they are gone through in one array.
MOST_ROWS = 512


def without_double_counts(rows: DataFrame, keys: list[str], row_id: str, place: str, fragments: str, rank: str, distance: float, least_share: float = 0.5, tolerance: float | None = None, unit: str = "ppm", most: int = MOST_ROWS) -> DataFrame:
    """``rows`` without those that a better row of their ``keys`` explains: near in ``place`` and with enough fragments in common.

    Fragments are common if they are equal, or, with ``tolerance``, if the better row has one within it.

    The best row by ``rank`` (nulls last, then the smaller id) stays and removes its
    neighbours, then the next one that is left. Keys of up to ``most`` rows are shuffled once and
    gone through in that order. Of larger ones neighbours are found by a band join; in each
    round all rows that no better one is left beside stay and remove their neighbours, until
    no pair is left: as many rounds as the longest chain of better and better neighbours.
    """
    value = F.coalesce(F.col(rank).cast("double"), F.lit(float("-inf")))
    need = lambda f, g: F.ceil(F.least(F.size(f), F.size(g)) * least_share)
    common = lambda better, worse: F.size(F.array_intersect(better, worse)) if tolerance is None else n_overlapping(worse, better, tolerance, unit)

    def explained(kept: Column, row: Column) -> Column:
        beside = lambda k: (F.abs(k[place] - row[place]) <= distance) & (common(k[fragments], row[fragments]) >= need(k[fragments], row[fragments]))
        known = [row[k].isNotNull() for k in keys]
        return F.coalesce(reduce(lambda x, y: x & y, known, F.exists(kept, beside)), F.lit(False))

    def in_arrays(part: DataFrame) -> DataFrame:
        each = F.struct(F.struct((~F.isnan(value)).alias("n"), (-value).alias("v"), F.col(row_id).alias("i")).alias("o"), F.struct(*part.columns).alias("row"))
        first = F.array_sort(F.collect_list(each), lambda x, y: F.when(x.o < y.o, -1).when(x.o > y.o, 1).otherwise(0))
        ordered = part.groupBy(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)]).agg(F.transform(first, lambda x: x.row).alias("_rows"))
        kept = F.aggregate("_rows", F.slice("_rows", 1, 0), lambda done, x: F.when(explained(done, x), done).otherwise(F.concat(done, F.array(x))))
        return ordered.select(F.inline(kept))

    def in_rounds(part: DataFrame) -> DataFrame:
        narrow = part.select(*keys, row_id, place, fragments, value.alias("_rank"))
        other = narrow.select(*keys, F.col(row_id).alias("_o"), F.col(place).alias("_p"), F.col(fragments).alias("_f"), F.col("_rank").alias("_r"))
        better = (F.col("_rank") > F.col("_r")) | ((F.col("_rank") == F.col("_r")) & (F.col(row_id) < F.col("_o")))
        met = band_join(narrow, other, keys, place, "_p", distance).filter(better)
        pairs = met.filter(common(F.col(fragments), F.col("_f")) >= need(F.col(fragments), F.col("_f"))).select(F.col(row_id).alias("a"), F.col("_o").alias("b")).distinct()
        left, gone = stored(pairs, "better_pairs"), []
        while not left.isEmpty():
            staying = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
            gone.append(stored(left.join(staying, "a", "left_semi").select(F.col("b").alias("_gone")).distinct(), "removed"))
            out = gone[-1]
            left = stored(left.join(out, F.col("a") == F.col("_gone"), "left_anti").join(out, F.col("b") == F.col("_gone"), "left_anti"), "better_pairs")
        for out in gone:
            part = part.join(out, F.col(row_id) == F.col("_gone"), "left_anti")
        return part

    large = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*keys), "large_keys")
    if large.isEmpty():
        return in_arrays(rows)
    return in_arrays(ranges.matched(rows, large, keys, "left_anti")).unionByName(in_rounds(ranges.matched(rows, large, keys, "left_semi")))
