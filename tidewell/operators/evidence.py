"""What counts as evidence: pairs, best scores of peptides, gates, samples, chance matches, merged spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import ranges


def paired(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and target_/decoy_ columns of pairs that have both; of several rows of a class the largest values are taken."""
    sides = [F.max(F.when(F.col("decoy") == d, F.col(c))).alias(f"{n}_{c}") for c in columns for n, d in (("target", False), ("decoy", True))]
    both = rows.groupBy(*keys).agg(*sides, F.count_distinct("decoy").alias("_n"))
    return both.filter("_n = 2").drop("_n")


def peptide_scores(rows: DataFrame, order: list[str], peptide: str = "peptide", score: str = "score", q: str = "q") -> DataFrame:
    """peptide, score (the best), q (the least, of any row) and decoy of the first row by ``order``."""
    return rows.groupBy(peptide).agg(F.max(score).alias("score"), F.min(q).alias("q"), F.min_by("decoy", F.struct(*order)).alias("decoy"))


def qualifies(decoy: Column, precursor_q: Column, peptide_q: Column, protein_q: Column, threshold: float, protein_threshold: float = 0.0) -> Column:
    """A target whose precursor passes, and whose peptide does, or its protein if a threshold is set for these."""
    other = peptide_q <= threshold
    if protein_threshold > 0:
        other = other | (protein_q <= protein_threshold)
    return ~decoy & (precursor_q <= threshold) & other


def in_curve(df: DataFrame, curves: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Rows whose ``x`` lies between the first and the last knot of their curve."""
    ends = curves.select(*keys, F.get("knots", F.lit(0)).alias("_first"), F.element_at("knots", -1).alias("_last"))
    return df.join(ends, keys).filter(F.col(x).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def within_mass_error(error: Column, mean: Column, tolerance: Column, plain: float) -> Column:
    """An error within the calibrated tolerance of its mean, or within ``plain`` where nothing is calibrated."""
    return F.when(tolerance.isNotNull(), F.abs(error - mean) <= tolerance).otherwise(F.abs(error) <= plain)


def mass_errors(df: DataFrame, keys: list[str], error: str) -> DataFrame:
    """keys, mean, mean_abs, sd (population) of the errors."""
    return df.groupBy(*keys).agg(F.avg(error).alias("mean"), F.avg(F.abs(error)).alias("mean_abs"), F.stddev_pop(error).alias("sd"))


def spread_sample(df: DataFrame, keys: list[str], x: str, order: list[str], bins: int, per_bin: int) -> DataFrame:
    """The first ``per_bin`` rows by ``order`` of each of ``bins`` even ranges of x: a sampling operator, ``bins * per_bin`` rows of each ``keys`` at most."""
    ends = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    even = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    placed = df.join(ends, keys).withColumn("_bin", even)
    nth = F.row_number().over(W.partitionBy(*keys, "_bin").orderBy(*order))
    return placed.withColumn("_nth", nth).filter(F.col("_nth") <= per_bin).drop("_lo", "_hi", "_bin", "_nth")


def whole_groups(df: DataFrame, group: str, most: int, seed: int = 42) -> DataFrame:
    """Whole groups in the order of a hash, as long as they fit in ``most`` rows together: a sampling operator that cuts no group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))))
    order = [F.col("_h"), F.col(group)]
    upto = ranges.with_running(ranges.ranged(sizes, [], order, "group_sizes"), [], order, {"_upto": F.col("_n")})
    return df.join(upto.filter(F.col("_upto") <= most).select(group), group, "left_semi")


#: Fixed values of the chance estimate: bins a unit of score, bins in all, the value that says there is none, its limits, scores needed.
SCALE, BINS, NO_ESTIMATE, LEAST_LOG, MOST_LOG, LEAST_SCORES = 50.0, 152, 999.0, -10.0, 10.0, 10
#: The line is drawn through the filled ones of so many bins below the end of the chance scores; three of them at least.
#: A gap of so many empty bins ends the chance scores, from this bin on.
TAIL_BINS, TAIL_LEAST, GAP, FIRST_GAP = 10, 3, 2, 5


def expectation(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """keys, best, e_value: how many matches as good as the best are to be expected by chance among all scores of the key.

    Chance scores are those below the first gap of the key's histogram, or, if it has none, all but its highest bin. How
    many of them reach a bin falls about exponentially with the bin, so a line through the logarithms of these counts over
    the last TAIL_BINS bins is carried on to the best score. There is no estimate (NO_ESTIMATE) without LEAST_SCORES scores,
    TAIL_LEAST filled bins and a falling line. A key has BINS rows at most from the first aggregation on.
    """
    bin_of = F.when(F.col(score) > 0, F.least(F.floor(F.col(score) * SCALE + 0.5), F.lit(BINS - 1))).otherwise(-1).cast("int")
    counted = df.filter(F.col(score).isNotNull()).groupBy(*keys, bin_of.alias("bin")).agg(F.count("*").alias("n"), F.max(score).cast("double").alias("best"))
    up, down = W.partitionBy(*keys).orderBy("bin"), W.partitionBy(*keys).orderBy(F.desc("bin"))
    key = W.partitionBy(*keys)
    rows = counted.withColumns({"best": F.max("best").over(key), "all": F.sum("n").over(key)})
    steps = rows.filter((F.col("bin") >= 0) & (F.col("bin") < BINS - 1)).withColumn("step", F.lead("bin").over(up) - F.col("bin"))
    gap = F.min(F.when((F.col("bin") >= FIRST_GAP) & (F.col("step") > GAP), F.col("bin"))).over(key)
    end = F.coalesce(gap, F.max(F.when(F.col("step").isNotNull(), F.col("bin"))).over(key))
    chance = steps.withColumn("end", end).filter(F.col("bin") <= F.col("end")).withColumn("reach", F.log10(F.sum("n").over(down)))
    tail = chance.filter(F.col("bin") > F.col("end") - TAIL_BINS)
    lines = tail.groupBy(*keys).agg(F.regr_slope("reach", "bin").alias("slope"), F.regr_intercept("reach", "bin").alias("at_zero"), F.count("*").alias("filled"))
    heads = rows.groupBy(*keys).agg(F.max("best").alias("best"), F.max("all").alias("all"))
    sound = (F.col("all") >= LEAST_SCORES) & (F.col("filled") >= TAIL_LEAST) & (F.col("slope") < 0)
    power = F.greatest(F.least(F.col("slope") * SCALE * F.col("best") + F.col("at_zero"), F.lit(MOST_LOG)), F.lit(LEAST_LOG))
    e_value = F.when(sound, F.least(F.pow(F.lit(10.0), power), F.lit(NO_ESTIMATE))).otherwise(NO_ESTIMATE)
    return ranges.matched(heads, lines, keys, "left").select(*keys, "best", e_value.alias("e_value"))


def merged_peaks(peaks: Column, tolerance: float) -> Column:
    """Peaks (mz, intensity) by place, where those up to ``tolerance`` above the first of a group are one: mean place, summed intensity."""
    kind = "struct<done:array<struct<mz:double,intensity:double>>,base:double,total:double,n:bigint,intensity:double>"
    empty = F.from_json(F.lit('{"done": []}'), kind)
    closed = lambda s: F.when(s.n.isNull(), s.done).otherwise(F.concat(s.done, F.array(F.struct((s.total / s.n).alias("mz"), s.intensity.alias("intensity")))))

    def step(s: Column, p: Column) -> Column:
        mz, height = p.mz.cast("double"), p.intensity.cast("double")
        joins = s.n.isNotNull() & (mz - s.base <= tolerance)
        grown = F.struct(s.done.alias("done"), s.base.alias("base"), (s.total + mz).alias("total"), (s.n + 1).alias("n"), (s.intensity + height).alias("intensity"))
        fresh = F.struct(closed(s).alias("done"), mz.alias("base"), mz.alias("total"), F.lit(1).cast("long").alias("n"), height.alias("intensity"))
        return F.when(joins, grown).otherwise(fresh).cast(kind)

    return F.aggregate(F.array_sort(peaks), empty, step, closed)


def around_apex(spectra: DataFrame, keys: list[str], order: str, apex: Column, tolerance: float, window: int = 5) -> DataFrame:
    """keys, mz, intensity: the merged peaks of the ``window`` scans around that nearest to ``apex``, the earlier one on a tie.

    ``spectra`` has peaks (array of mz, intensity).
    """
    w = W.partitionBy(*keys).orderBy(order)
    placed = spectra.withColumn("_i", F.row_number().over(w)).withColumn("_off", F.abs(F.col(order) - apex))
    nearest = placed.groupBy(*keys).agg(F.min(F.struct("_off", "_i")).alias("_t"))
    near = placed.join(nearest, keys).filter(F.abs(F.col("_i") - F.col("_t._i")) <= window // 2)
    return near.groupBy(*keys).agg(F.flatten(F.collect_list("peaks")).alias("peaks")).select(*keys, F.inline(merged_peaks(F.col("peaks"), tolerance)))
