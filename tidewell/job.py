"""From spectra and a catalogue to a report: calibration, search, error rates and accepted items as resumable stages."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import apex, calibration, fdr, local_fit, models, survey
from tidewell.operators.calibration import RUN
from tidewell.stages import Stage, run_stages
from tidewell.storage import stored


def spectra_table(spark: SparkSession, path: str) -> DataFrame:
    """Fragment spectra of Parquet tables or mzML files."""
    if path.lower().rstrip("/").endswith(".parquet"):
        scans = spark.read.parquet(path)
        return scans.filter("ms_level = 2") if "ms_level" in scans.columns else scans
    from tidewell.sources.mzml import MzmlSource

    spark.dataSource.register(MzmlSource)
    return spark.read.format("mzml").load(path).filter("ms_level = 2")


def survey_table(spark: SparkSession, path: str) -> DataFrame:
    """Survey spectra at the same path; none in Parquet tables without ms_level."""
    if not path.lower().rstrip("/").endswith(".parquet"):
        from tidewell.sources.mzml import MzmlSource

        spark.dataSource.register(MzmlSource)
        scans = spark.read.format("mzml").load(path)
    else:
        scans = spark.read.parquet(path)
        scans = scans if "ms_level" in scans.columns else scans.withColumn("ms_level", F.lit(2))
    return scans.filter("ms_level = 1").select("file_name", "scan", "rt", "mzs", "intensities")


def searched(entries: DataFrame, spectra: DataFrame, surveys: DataFrame, curves: DataFrame, ppm: float) -> DataFrame:
    """The best peak of each entry in each run that has a curve, around the time that the curve gives, with its features."""
    by_curve = lambda met: local_fit.apply_curves(met, curves, RUN, "rt", "_t").withColumn("rt", F.col("_t")).drop("_t")
    found = stored(calibration.matches(entries, spectra, curves.select(*RUN, "tolerance"), by_curve, ppm), "job_matches")
    errors = survey.survey_errors(found.filter(~F.col("decoy")), entries, surveys, ppm)
    seen = survey.with_survey_features(found, entries, surveys, ppm, stored(errors, "job_survey_errors"))
    return apex.with_apex_features(seen, entries, spectra, ppm).drop("profile_rt", "profile")


def rated(found: DataFrame, threshold: float) -> DataFrame:
    """``found`` with score, run_q, exp_q and pep; rows that lose their pair, or aren't their item's best over all runs, have 1."""
    copies = {f"_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in apex.MODEL_FEATURES}  # the model takes its features away
    scored = stored(models.score(found.withColumns(copies), list(copies), "base", "base", threshold, best="_coelution", averaged=True).drop("fold"), "job_scores")
    run = fdr.run_q_values(scored, "file_name", "base").select(*RUN, "base", "decoy", F.col("q").alias("run_q"))
    best = fdr.experiment_q_values(scored)
    chances = models.error_chances(best).select("base", "decoy", F.col("score").alias("_best"), F.col("q").alias("exp_q"), "pep")
    joined = scored.join(run, [*RUN, "base", "decoy"], "left").join(chances, ["base", "decoy"], "left")
    mine = F.col("score") == F.col("_best")
    one = {c: F.when(mine, F.col(c)).otherwise(1.0) for c in ("exp_q", "pep")}
    return joined.withColumns({"run_q": F.coalesce("run_q", F.lit(1.0))} | {c: F.coalesce(v, F.lit(1.0)) for c, v in one.items()}).drop("_best")


def report(rows: DataFrame, threshold: float) -> DataFrame:
    """Targets that pass in their run and over all runs (by their best row), with the number of runs in which they pass."""
    passing = rows.filter(~F.col("decoy") & (F.col("run_q") <= threshold))
    accepted = rows.filter(~F.col("decoy") & (F.col("exp_q") <= threshold)).select("base").distinct()
    n_runs = passing.groupBy("base").agg(F.count_distinct("file_name").alias("n_runs"))
    columns = ["file_name", "entry_id", "base", "apex_rt", "start_rt", "end_rt", "area", "score", "run_q", "exp_q", "pep"]
    return passing.join(accepted, "base", "left_semi").join(n_runs, "base").select(*columns, "n_runs")


def stages_of(spectra: str, entries: str, settings: calibration.Settings = calibration.Settings()) -> list[Stage]:
    """The job's stages over the spectra and the entries (Parquet) at these paths."""
    options = asdict(settings)

    def curves(spark, t, o):
        return calibration.calibrate(t["entries"], t["spectra"], calibration.Settings(**o)).curves

    return [
        Stage("spectra", lambda spark, t, o: spectra_table(spark, spectra), reads=(spectra,)),
        Stage("surveys", lambda spark, t, o: survey_table(spark, spectra), reads=(spectra,)),
        Stage("entries", lambda spark, t, o: spark.read.parquet(entries), reads=(entries,)),
        Stage("curves", curves, ("entries", "spectra"), settings=options),
        Stage("matches", lambda spark, t, o: searched(t["entries"], t["spectra"], t["surveys"], t["curves"], o["ppm"]), ("entries", "spectra", "surveys", "curves"), settings={"ppm": settings.ppm}),
        Stage("rated", lambda spark, t, o: rated(t["matches"], o["threshold"]), ("matches",), settings={"threshold": settings.threshold}),
        Stage("report", lambda spark, t, o: report(t["rated"], o["threshold"]), ("rated",), settings={"threshold": settings.threshold}),
    ]


def run(spark: SparkSession, spectra: str, entries: str, folder: str, settings: calibration.Settings = calibration.Settings()) -> tuple[DataFrame, list[str]]:
    """The report, and the stages that were run for it; those whose inputs and settings are as before are taken over from ``folder``."""
    tables, ran = run_stages(spark, stages_of(spectra, entries, settings), folder)
    return tables["report"], ran
