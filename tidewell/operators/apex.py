"""Features of the scans at a match's apex: cross-correlation, explained intensity, mass errors.

Together with those that the search gives with each peak and those of survey scans
(``operators.survey``) these are the model's features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import arrays
from tidewell.operators import correlation, local_fit, search
from tidewell.storage import stored

#: Features of a match, in the order in which the model takes them.
MODEL_FEATURES = [
    "coelution", "coelution_max", "n_coeluting", "apex", "area", "sharpness", "xcorr", "consecutive", "explained", "mass_error", "abs_mass_error", "rt_off", "abs_rt_off",
    "survey_coelution", "survey_isotopes", "polish_cosine", "polish_ratio", "smoothed_xcorr", "smoothed_cosine", "polish_least_r2", "polish_correlation",
]


def around(found: DataFrame, entries: DataFrame, spectra: DataFrame) -> DataFrame:
    """file_name, entry_id, off (-2 to 2), scan, mzs, intensities: the scans at and beside each match's apex, of the window that selects it."""
    key = {"low_key": F.floor(F.col("iso_low") * 10), "high_key": F.floor(F.col("iso_high") * 10)}
    place = F.row_number().over(W.partitionBy("file_name", "low_key", "high_key").orderBy("rt", "scan"))
    scans = stored(spectra.withColumns(key).withColumn("at", place).select("file_name", "low_key", "high_key", "at", "rt", "scan", "iso_low", "iso_high", "mzs", "intensities"), "placed_scans")
    narrow = scans.select("file_name", "low_key", "high_key", "at", F.col("rt").alias("apex_rt"), "iso_low", "iso_high")
    matches = found.select("file_name", "entry_id", "apex_rt").join(entries.select("entry_id", "precursor_mz"), "entry_id")
    inside = (F.col("precursor_mz") >= F.col("iso_low")) & (F.col("precursor_mz") < F.col("iso_high"))
    apexes = matches.join(narrow, ["file_name", "apex_rt"]).filter(inside).groupBy("file_name", "entry_id").agg(F.min(F.struct("low_key", "high_key", "at")).alias("a"))
    offs = F.explode(F.array(*map(F.lit, range(-2, 3)))).alias("off")
    wanted = apexes.select("file_name", "entry_id", "a.low_key", "a.high_key", "a.at", offs).withColumn("at", F.col("at") + F.col("off"))
    return wanted.join(scans.select("file_name", "low_key", "high_key", "at", "scan", "mzs", "intensities"), ["file_name", "low_key", "high_key", "at"]).select("file_name", "entry_id", "off", "scan", "mzs", "intensities")


def closest_peak(mz: Column, peaks: Column, ppm: float) -> Column:
    """(error in ppm, intensity) of the peak (mz, y) closest to ``mz`` within ``ppm``, the lower one on a tie; null without any."""
    at = local_fit.place(peaks, mz, "mz")
    near = F.filter(F.array(F.get(peaks, at - 1), F.get(peaks, at)), lambda p: p.isNotNull() & (F.abs(p.mz - mz) <= mz * ppm / 1e6))
    best = F.array_min(F.transform(near, lambda p: F.struct(F.abs(p.mz - mz).alias("d"), p.mz.alias("m"), p.y.alias("y"))))
    return F.when(best.isNotNull(), F.struct(((best.m - mz) / mz * 1e6).alias("error"), best.y.alias("y")))


def longest_ions(fragments: Column, close: Column) -> Column:
    """The longest run of ordinals, of b or of y ions, whose element of ``close`` isn't null."""
    shown = F.zip_with(fragments, close, lambda f, h: F.struct(F.when(h.isNotNull(), F.lower(f.ion_type)).alias("ion"), f.ordinal.alias("ordinal")))

    def run(ion: str) -> Column:
        return arrays.longest_run(F.transform(F.filter(shown, lambda x: x.ion == ion), lambda x: x.ordinal))

    return F.greatest(run("b"), run("y"))


def with_apex_features(found: DataFrame, entries: DataFrame, spectra: DataFrame, ppm: float) -> DataFrame:
    """``found`` (of ``search.search``, one peak an entry and run) with xcorr, smoothed_xcorr, consecutive, explained, mass_error, abs_mass_error, rt_off, abs_rt_off.

    Cross-correlation takes all of an entry's fragments; smoothed, it is that of five scans around the apex, those beyond the
    run left out. explained: the share of the apex scan's intensity in peaks next to a fragment. consecutive: the longest run
    of b or y ions among these, 0 if fragments have no ``ion_type`` and ``ordinal``.
    """
    near = stored(around(found, entries, spectra), "apex_scans")
    peaks = near.select("file_name", "scan", F.explode(F.arrays_zip(F.col("mzs").alias("mz"), F.col("intensities").alias("y"))).alias("p")).select("file_name", "scan", "p.mz", "p.y").distinct()
    fragments = entries.select("entry_id", F.explode("fragments").alias("f")).select("entry_id", "f.mz")
    scores = correlation.cross_correlation(near.select("file_name", "scan", "entry_id", "off"), fragments, peaks, ["file_name", "scan"], "entry_id", "mz", "y")
    weight = F.element_at(F.array(*map(F.lit, search.SMOOTHING)), F.col("off") + 3)
    by_match = scores.groupBy("file_name", "entry_id").agg(F.sum(F.when(F.col("off") == 0, F.col("xcorr"))).alias("xcorr"), F.sum(F.col("xcorr") * weight).alias("smoothed_xcorr"))
    scan = F.arrays_zip(F.col("mzs").alias("mz"), F.col("intensities").alias("y"))
    apex = near.filter("off = 0").select("file_name", "entry_id", scan.alias("peaks")).join(entries.select("entry_id", "fragments"), "entry_id")
    close = F.transform("fragments", lambda f: closest_peak(f.mz, F.col("peaks"), ppm))
    named = {"ion_type", "ordinal"} <= set(entries.schema["fragments"].dataType.elementType.names)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    whole, n = total(F.transform("peaks", lambda p: p.y.cast("double"))), F.size("hits")
    errors = lambda f: F.when(n > 0, total(F.transform("hits", lambda h: f(h.error))) / n).otherwise(0.0)
    apex = apex.withColumn("close", close).withColumn("hits", F.filter("close", lambda h: h.isNotNull()))
    consecutive = longest_ions(F.col("fragments"), F.col("close")) if named else F.lit(0)
    explained = F.when(whole > 0, total(F.transform("hits", lambda h: h.y.cast("double"))) / whole).otherwise(0.0)
    masses = apex.select("file_name", "entry_id", consecutive.alias("consecutive"), explained.alias("explained"), errors(lambda e: e).alias("mass_error"), errors(F.abs).alias("abs_mass_error"))
    off = F.col("apex_rt") - F.col("expected_rt")
    joined = found.join(by_match, ["file_name", "entry_id"], "left").join(masses, ["file_name", "entry_id"], "left")
    return joined.withColumns({"rt_off": off, "abs_rt_off": F.abs(off)})
