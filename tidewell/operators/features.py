"""Features of a match: agreement over the whole peak, covered cleavage sites, ranks, and error rates of all levels with chances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import fdr, models
from tidewell.storage import stored


def elution_cosine(matches: DataFrame, totals: DataFrame, keys: list[str], scan: str, weight: str, expected: str, observed: str, total: str, empty: float = 0.0) -> DataFrame:
    """keys, cosine: the root cosine of expected and observed intensities at each scan, averaged with the squares of ``weight``.

    ``matches`` has a row for each fragment that a scan shows; ``totals`` (keys, total) what is expected of all fragments,
    shown or not. Scans without a positive weight don't count; 0 if none does. ``empty`` is the cosine of a scan whose
    observed intensities are all 0.
    """
    each = matches.filter(F.col(weight) > 0).groupBy(*keys, scan, weight).agg(F.sum(F.sqrt(F.col(expected) * F.col(observed))).alias("_dot"), F.sum(observed).alias("_o")).join(totals, keys)
    size = F.sqrt(F.col(total) * F.col("_o"))
    cosine = F.when(size > 0, F.least(F.lit(1.0), F.col("_dot") / size)).otherwise(float(empty))
    square = F.col(weight) * F.col(weight)
    return each.groupBy(*keys).agg((F.sum(cosine * square) / F.sum(square)).alias("cosine"))


def cleavage_coverage(length: Column, matches: Column) -> Column:
    """Share of a sequence's cleavage sites that matches (ion b or y, ordinal) cover; 0 for fewer than two residues."""
    inside = F.filter(matches, lambda m: (m.ordinal > 0) & (m.ordinal < length) & m.ion.isin("b", "y"))
    sites = F.array_distinct(F.transform(inside, lambda m: F.when(m.ion == "b", m.ordinal).otherwise(length - m.ordinal)))
    return F.when(length >= 2, F.size(sites) / (length - 1)).otherwise(0.0)


def base_peak_rank(matches: Column) -> Column:
    """Of matches (expected, observed), the place from 1 of the largest observed one among the expected ones; the last one on a tie, 0 without any."""
    top = F.array_max(F.transform(matches, lambda m, i: F.struct(m.observed.alias("o"), i.alias("i"), m.expected.alias("e"))))
    return F.when(F.size(matches) > 0, F.size(F.filter(matches, lambda m: m.expected > top.e)) + 1).otherwise(0)


def rated_levels(rows: DataFrame, order: list[str], run: str = "run", base: str = "base", peptide: str = "peptide", only: DataFrame | None = None) -> DataFrame:
    """``fdr.all_levels`` with ``pep``: the chance of an error of a row that stands for its pair over all runs, 1 for all others.

    ``only`` (base): pairs that are rated; the other rows stay, with 1 at every level.
    """
    levels = ["run_precursor_q", "run_peptide_q", "exp_precursor_q", "exp_peptide_q"]
    used = rows if only is None else rows.join(only.select(base).distinct(), base, "left_semi")
    rated = stored(fdr.all_levels(used, order, run, base, peptide), "levels")
    winners = fdr.compete(rated, [base])
    chances = models.error_chances(winners).select(F.col(base).alias("_b"), F.col("decoy").alias("_d"), F.col("score").alias("_s"), F.col("pep").alias("_p"))
    stands = (F.col(base) == F.col("_b")) & (F.col("decoy") == F.col("_d")) & (F.col("score") == F.col("_s"))
    out = rated.join(chances, stands, "left").withColumn("pep", F.coalesce("_p", F.lit(1.0))).drop("_b", "_d", "_s", "_p")
    if only is None:
        return out
    rest = rows.join(only.select(base).distinct(), base, "left_anti").select(*rows.columns, *[F.lit(1.0).alias(c) for c in [*levels, "pep"]])
    return out.select(*rows.columns, *levels, "pep").unionByName(rest)
