"""Operators with numerical kernels: peaks of event series, calibration of orders, scored lines. No SQL has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import kernels
from tidewell.operators import apex, fdr, local_fit, models, peaks, search, survey
from tidewell.session import table
from tidewell.storage import stored


def event_matrix(spark, sf_dir):
    """Each user's value by event type (rows) and time slot (columns)."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = events.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    slot = F.floor((F.col("at") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * 120)
    placed = events.crossJoin(F.broadcast(ends)).withColumn("slot", slot)
    return placed.groupBy("user_id", "event_type", "slot").agg(F.sum("value").alias("value"))


def detected(spark, sf_dir):
    return peaks.detect(event_matrix(spark, sf_dir), ["user_id"], "event_type", "slot", "value")


def polished(spark, sf_dir):
    """Each user's values, and how far event types share them as they do over all users."""
    whole = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("expected"))
    return peaks.polish(event_matrix(spark, sf_dir).join(whole, "event_type"), ["user_id"], "event_type", "slot", "value", "expected")


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double").alias("day"))


def curves(spark, sf_dir):
    return local_fit.fit_curves(orders(spark, sf_dir), ["o_orderpriority"], "day", "o_totalprice").select("o_orderpriority", "n", "sd", "mad")


def calibrated(spark, sf_dir):
    rows = orders(spark, sf_dir)
    fitted = local_fit.fit_curves(rows, ["o_orderpriority"], "day", "o_totalprice")
    placed = local_fit.apply_curves(rows, fitted, ["o_orderpriority"], "day", "expected")
    return local_fit.local_tolerance(placed, fitted, ["o_orderpriority"], "day", 3.0, 0.5).select("o_orderkey", "expected", "tolerance")


def scored_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("base"), (F.col("l_linenumber") % 2 == 0).alias("decoy"), F.col("l_partkey").alias("peptide"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return models.experiment(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def discriminated(spark, sf_dir):
    """Lines by one discriminant of their measures, with q-values and the calibration's error chances."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("base"), (F.col("l_linenumber") % 2 == 0).alias("decoy"), F.col("l_partkey").alias("peptide"), F.col("l_extendedprice"), "l_quantity", "l_discount", "l_tax")
    scored = models.discriminant_scores(rows, ["l_extendedprice", "l_quantity", "l_discount", "l_tax"], threshold=0.5)
    winners = fdr.q_values(fdr.compete(models.normalized(scored, 0.5), ["base"]), ["base"], fdr.CALIBRATION)
    return models.error_chances(winners, kernels.calibration_chances)


def catalogue(spark, sf_dir):
    """(entries, scans): users as catalogue entries and isolation windows, event types as fragments, time slots as scans."""
    slots = event_matrix(spark, sf_dir).withColumn("mz", F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(9000)) / 10.0 + 100)
    peaks_of = F.array_sort(F.collect_list(F.struct("mz", F.col("value").alias("y"))))
    center = 400.0 + F.col("user_id")
    scans = slots.groupBy("user_id", "slot").agg(peaks_of.alias("p")).select(
        F.lit("events").alias("file_name"), F.col("slot").alias("scan"), F.col("slot").cast("double").alias("rt"), (center - 0.4).alias("iso_low"), (center + 0.4).alias("iso_high"), F.col("p.mz").alias("mzs"), F.col("p.y").alias("intensities")
    )
    fragments = F.array_sort(F.collect_list(F.struct("mz", F.col("total").alias("intensity"))))
    by_type = slots.groupBy("user_id", "mz").agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("slot")).alias("moment"))
    entries = by_type.groupBy("user_id").agg(fragments.alias("fragments"), (F.sum("moment") / F.sum("total")).alias("rt")).select(F.col("user_id").alias("entry_id"), (400.0 + F.col("user_id")).alias("precursor_mz"), "rt", "fragments", F.lit(False).alias("decoy"))
    return entries, scans


def searched(spark, sf_dir):
    """Five peaks of each user."""
    return search.search(*catalogue(spark, sf_dir), rt_tolerance=60.0, ppm=20.0, top=5)


def featured(spark, sf_dir):
    """The best peak of each user with all features of the model."""
    entries, scans = catalogue(spark, sf_dir)
    found = stored(search.search(entries, scans, rt_tolerance=60.0, ppm=20.0), "matches")
    slots = event_matrix(spark, sf_dir).groupBy("user_id", "slot").agg(F.sum("value").alias("y"))
    surveys = slots.select(F.lit("events").alias("file_name"), F.col("slot").alias("scan"), F.col("slot").cast("double").alias("rt"), (400.0 + F.col("user_id")).alias("at"), "y")
    seen = survey.with_survey_features(found, entries, surveys, 20.0)
    return apex.with_apex_features(seen, entries, scans, 20.0).select("entry_id", "apex_rt", *apex.MODEL_FEATURES)


QUERIES = {
    "peaks_consensus": detected,
    "peaks_median_polish": polished,
    "calibration_curves": curves,
    "calibration_applied": calibrated,
    "model_experiment": scored_lines,
    "model_discriminant": discriminated,
    "search_peaks": searched,
    "search_features": featured,
}
ORACLE_SQL: dict = {}
