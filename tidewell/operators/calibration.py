"""Calibration of runs before the search: times and masses of entries that a sample finds beyond doubt.

All runs go through the loop together. An attempt draws a spread sample of the targets with
their decoys, searches it in the runs that are still open, keeps the best match of each
entry so far, and rates all of them by one discriminant and by competition within each run.
Runs in which enough targets pass get a curve of times; if that is much narrower than the
tolerance searched with, they are searched again around it, and the new curve stays if it
explains as much. The other runs go on with a larger sample, the last time with all entries.

Every attempt's matches and points are stored tables. The driver sees one row a run and
attempt. Runs have tolerances of their own: times are divided by them for the search.

``entries``: entry_id, base, precursor_mz, rt, fragments, decoy; ``spectra`` as in
operators.search.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import fdr, local_fit, models, search, stats
from tidewell.operators.dedup import best_row
from tidewell.storage import stored

RUN = ["file_name"]
FEATURES = ["coelution", "similarity", "n_fragments", "snr"]
#: Standard deviations of a normal distribution in its median absolute deviation; those a tolerance covers.
MAD_SD, COVER = 1.4826, 3.0
ATTEMPT = "file_name string, attempt int, sampled long, matched long, passing long, state string, searched double, first_tolerance double, tolerance double, refined boolean, r2 double"


@dataclass(frozen=True)
class Settings:
    """sample: targets of the first attempt (0: all). enough: points that end the attempts. fewest: points without which there is no curve."""

    sample: int = 2000
    growth: float = 2.0
    attempts: int = 3
    enough: int = 200
    fewest: int = 50
    threshold: float = 0.01
    least_snr: float = 5.0
    narrowest: float = 0.1
    widest: float = 3.0
    bandwidth: float = 0.3
    ppm: float = 10.0
    seed: int = 42
    keep_r2: float = 0.99


def time_lines(entries: DataFrame, spectra: DataFrame) -> DataFrame:
    """file_name, slope, intercept, tolerance: how times of entries become times of a run before anything is known.

    Scales of about the same range are taken to be the same, with a fifth of the run's length as tolerance; others are
    stretched onto the run's, with half of it.
    """
    known = entries.filter(~F.col("decoy")).agg(F.min("rt").alias("_lo"), F.max("rt").alias("_hi"))
    runs = spectra.groupBy(*RUN).agg(F.min("rt").alias("_first"), F.max("rt").alias("_last")).crossJoin(F.broadcast(known))  # one row
    theirs, ours = F.col("_hi") - F.col("_lo"), F.col("_last") - F.col("_first")
    alike = (theirs > 0) & (ours > 0) & (F.greatest(theirs / ours, ours / theirs) < 2) & (F.abs(F.col("_lo") - F.col("_first")) < theirs / 2)
    slope = F.when(alike, 1.0).otherwise(F.when(theirs > 0, ours / theirs).otherwise(1.0))
    intercept = F.when(alike, 0.0).otherwise(F.col("_first") - slope * F.col("_lo"))
    return runs.select(*RUN, slope.alias("slope"), intercept.alias("intercept"), (ours * F.when(alike, 0.2).otherwise(0.5)).alias("tolerance"))


def sampled(entries: DataFrame, size: int, seed: int) -> DataFrame:
    """A spread sample of ``size`` targets (0: all entries) and the decoys of their pairs."""
    if not size:
        return entries
    targets = entries.filter(~F.col("decoy")).select("base", "rt", "precursor_mz")
    chosen = stats.stride_sample(targets, "rt", "precursor_mz", "base", size, seed)
    return entries.join(chosen.select("base").distinct(), "base", "left_semi")


def matches(entries: DataFrame, spectra: DataFrame, tolerances: DataFrame, expected: Callable[[DataFrame], DataFrame], ppm: float) -> DataFrame:
    """The best peak of each entry in each run, with the entry's rt and base.

    ``tolerances`` has (file_name, tolerance), a row for each run that is searched. ``expected`` gives entries their time in
    the run. Times in tolerances of the run serve the search, and are turned back after it.
    """
    scans = spectra.join(tolerances, RUN).withColumn("_rt", F.col("rt")).withColumn("rt", F.col("rt") / F.col("tolerance")).drop("tolerance")
    places = scans.groupBy(*RUN, F.col("rt").alias("apex_rt")).agg(F.min("_rt").alias("_rt"))  # a scan's time to the last bit, for joins on it
    scaled = lambda met: expected(met).join(tolerances, RUN).withColumn("rt", F.col("rt") / F.col("tolerance")).drop("tolerance")
    found = search.search(entries.select("entry_id", "precursor_mz", "rt", "fragments", "decoy"), scans.drop("_rt"), 1.0, ppm, expected=scaled).join(places, [*RUN, "apex_rt"]).join(tolerances, RUN)
    times = {c: F.col(c) * F.col("tolerance") for c in ("expected_rt", "start_rt", "end_rt", "area")} | {"apex_rt": F.col("_rt"), "sharpness": F.col("sharpness") / F.col("tolerance"), "profile_rt": F.transform("profile_rt", lambda t: t * F.col("tolerance"))}
    return found.withColumns(times).drop("tolerance", "rank", "_rt").join(entries.select("entry_id", "base", "rt"), "entry_id")


def passing(found: DataFrame, settings: Settings) -> DataFrame:
    """Target rows of ``found`` that win their pair in their run, pass the threshold and stand out of the noise, with score and q."""
    pair = F.concat_ws("|", "file_name", "base")
    copies = {f"_{f}": F.col(f) for f in FEATURES}  # the model takes its features away
    scored = stored(models.discriminant_scores(found.withColumns({"pair": pair} | copies), list(copies), "pair", "pair", settings.threshold), "calibration_scores")
    winners = fdr.q_values(fdr.compete(scored, [*RUN, "base"]), ["base"], fdr.CALIBRATION, RUN)
    good = winners.filter(~F.col("decoy") & (F.col("q") <= settings.threshold)).select(*RUN, "base", "q")
    return scored.filter(~F.col("decoy") & (F.col("snr") >= settings.least_snr)).join(good, [*RUN, "base"]).drop("pair")


def curves(points: DataFrame, settings: Settings) -> DataFrame:
    """Stored curves of the runs from an entry's rt to its time in the run, with r2 and the tolerance that their residuals ask for."""
    fitted = local_fit.fit_curves(points, RUN, "rt", "apex_rt", settings.bandwidth, settings.fewest)
    placed = local_fit.apply_curves(points, fitted, RUN, "rt", "_fitted")
    quality = stats.fit_quality(placed, RUN, "apex_rt", "_fitted").select(*RUN, "r2", "p20", "p80")
    tolerance = F.least(F.greatest(F.col("mad") * MAD_SD * COVER, F.lit(settings.narrowest)), F.lit(settings.widest))
    return stored(fitted.join(quality, RUN).withColumn("tolerance", tolerance), "time_curves")


def mass_errors(points: DataFrame, entries: DataFrame, spectra: DataFrame, ppm: float) -> DataFrame:
    """file_name, n, mean, median, sd, tolerance: errors in ppm of the peaks closest to an entry's fragments in the scan of its apex."""
    kept = points.select(*RUN, "entry_id", "apex_rt").join(entries.select("entry_id", "precursor_mz", search.top_fragments(F.col("fragments")).alias("fragments")), "entry_id")
    scans = spectra.select(*RUN, F.col("rt").alias("apex_rt"), "iso_low", "iso_high", "mzs")
    met = kept.join(scans, [*RUN, "apex_rt"]).filter((F.col("precursor_mz") >= F.col("iso_low")) & (F.col("precursor_mz") < F.col("iso_high")))
    errors = F.filter(F.transform("fragments", lambda f: closest_error(f.mz, F.col("mzs"), ppm)), lambda e: e.isNotNull())
    each = stored(met.select(*RUN, F.explode(errors).alias("error")), "mass_errors")
    return stats.calibration_summary(each, RUN, "error")


def closest_error(mz: Column, mzs: Column, ppm: float) -> Column:
    """Signed error in ppm of the sorted place closest to ``mz``, the lower one on a tie; null if none is within ``ppm``."""
    at = local_fit.place(mzs, mz)
    near = F.filter(F.array(F.get(mzs, at - 1), F.get(mzs, at)), lambda m: F.abs(m - mz) <= mz * ppm / 1e6)
    best = F.array_min(F.transform(near, lambda m: F.struct(F.abs(m - mz).alias("d"), m.alias("m"))))
    return (best.m - mz) / mz * 1e6


@dataclass
class Calibration:
    """attempts: a row for each run and attempt (ATTEMPT). curves: as in ``curves``, of runs that have one. masses: as in ``mass_errors``."""

    attempts: DataFrame
    curves: DataFrame
    masses: DataFrame


def calibrate(entries: DataFrame, spectra: DataFrame, settings: Settings = Settings()) -> Calibration:
    """Curves and mass errors of all runs; a run for which there are too few points after the last attempt has none (state ``failed``)."""
    spark = entries.sparkSession
    lines = stored(time_lines(entries, spectra), "time_lines")
    searched = {r.file_name: r.tolerance for r in lines.collect()}  # a row per run
    open_runs, n_targets = sorted(searched), entries.filter(~F.col("decoy")).count()
    size = settings.sample if 0 < settings.sample < n_targets else 0
    attempts = settings.attempts if size and settings.growth > 1 else 1
    of = lambda df, runs: df.filter(F.col("file_name").isin(runs))
    by_line = lambda met: met.join(lines.drop("tolerance"), RUN).withColumn("rt", F.col("slope") * F.col("rt") + F.col("intercept")).drop("slope", "intercept")
    by_curve = lambda fitted: lambda met: local_fit.apply_curves(met, fitted, RUN, "rt", "_t").withColumn("rt", F.col("_t")).drop("_t")
    kept, report, done_curves, done_points = None, [], [], []
    for attempt in range(1, attempts + 1):
        last = attempt == attempts or not size
        sample = stored(sampled(entries, size, settings.seed + attempt), "calibration_sample")
        new = matches(sample, of(spectra, open_runs), of(lines, open_runs).select(*RUN, "tolerance"), by_line, settings.ppm)
        kept = stored(best_row(new if kept is None else of(kept, open_runs).unionByName(new), [*RUN, "entry_id"], F.desc("coelution"), "apex_rt"), "calibration_matches")
        points = stored(passing(kept, settings), "calibration_points")
        matched, passed = ({r.file_name: r["count"] for r in df.groupBy(*RUN).count().collect()} for df in (kept, points))
        ready = [r for r in open_runs if passed.get(r, 0) >= (settings.fewest if last else settings.enough)]
        rows = {r: dict(file_name=r, attempt=attempt, sampled=0, matched=matched.get(r, 0), passing=passed.get(r, 0), state="failed" if last else "again", searched=searched[r], first_tolerance=None, tolerance=None, refined=False, r2=None) for r in open_runs}
        n_sampled = sample.filter(~F.col("decoy")).count()
        for r in rows.values():
            r["sampled"] = n_sampled
        if ready:
            points = of(points, ready)
            first = curves(points, settings)
            fits = {r.file_name: r for r in first.select(*RUN, "r2", "tolerance").collect()}
            narrow = [r for r in ready if fits[r].tolerance < searched[r] / 2]
            better: list[str] = []
            if narrow:
                again = stored(passing(stored(matches(sample, of(spectra, narrow), of(first, narrow).select(*RUN, "tolerance"), by_curve(of(first, narrow)), settings.ppm), "refined_matches"), settings), "refined_points")
                second = curves(again, settings)
                refits = {r.file_name: r for r in second.select(*RUN, "r2", "tolerance").collect()}
                better = [r for r in narrow if r in refits and refits[r].r2 >= fits[r].r2 * settings.keep_r2]
                if better:
                    done_curves.append(of(second, better))
                    done_points.append(of(again, better))
                    for r in better:
                        rows[r] |= {"first_tolerance": fits[r].tolerance, "tolerance": refits[r].tolerance, "r2": refits[r].r2, "refined": True, "state": "done"}
            others = [r for r in ready if r not in better]
            if others:
                done_curves.append(of(first, others))
                done_points.append(of(points, others))
                for r in others:
                    rows[r] |= {"first_tolerance": fits[r].tolerance, "tolerance": fits[r].tolerance, "r2": fits[r].r2, "state": "done"}
        report += rows.values()
        open_runs = [r for r in open_runs if r not in ready]
        if last or not open_runs:
            break
        size = int(size * settings.growth)
        if attempt + 1 == attempts or size >= n_targets:
            size = 0

    def together(parts: list[DataFrame], none: DataFrame) -> DataFrame:
        out = parts[0] if parts else none.filter(F.lit(False))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    names = [c.split()[0] for c in ATTEMPT.split(", ")]
    table = spark.createDataFrame([tuple(r[n] for n in names) for r in report], ATTEMPT)
    empty_points = kept if kept is not None else entries
    all_points = together(done_points, empty_points)
    found_curves = together(done_curves, spark.createDataFrame([], "file_name string, knots array<double>, fitted array<double>, residuals array<double>, sd double, mad double, n long, r2 double, p20 double, p80 double, tolerance double"))
    return Calibration(table, found_curves, mass_errors(all_points, entries, spectra, settings.ppm))
