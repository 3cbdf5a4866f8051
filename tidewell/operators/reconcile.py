"""Reconciliation of runs: every accepted item gets one place in all of them.

Detections that pass in their run, mapped back through the run's curve, agree on a place of
each peptide (weighted medians). Curves are fitted again to these places. Each detection
then keeps its peak if it lies where the curve expects it, moves to the nearest of the
other peaks stored with it, or has its place forced; accepted items that a run lacks are
filled in where an isolation window of the run covers them.

``rows``: file_name, entry_id, peptide, charge, decoy (peptide and charge are those of the
target), apex, start, end, score, coelution, run_precursor_q, run_peptide_q, run_protein_q,
exp_precursor_q, exp_peptide_q, candidates (array of apex, start, end: the other peaks; only
these three are read from storage). ``curves``: file_name, knots, fitted, mad, as of
local_fit. ``library``: entry_id, peptide, charge, decoy, precursor_mz. ``windows``:
file_name, low, high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import align, evidence, local_fit, ranges, stats
from tidewell.operators.calibration import COVER, MAD_SD
from tidewell.operators.joins import range_join
from tidewell.storage import stored

RUN, PEPTIDE, PRECURSOR = ["file_name"], ["peptide", "decoy"], ["peptide", "charge"]
#: The spread of places where no peptide has been seen often enough, and the narrowest tolerance.
PLAIN_MAD, NARROWEST = 0.05, 0.1
#: Points that a curve needs to be fitted again.
LEAST_POINTS = 20


def consensus(rows: DataFrame, curves: DataFrame, threshold: float, protein_threshold: float = 0.0) -> DataFrame:
    """peptide, decoy, library_rt, width, n_runs, mad: what qualifying targets, and all decoys of their peptides, agree on."""
    q = {"precursor_q": "run_precursor_q", "peptide_q": "run_peptide_q", "protein_q": "run_protein_q"}
    good = evidence.qualifies(F.col("decoy"), *[F.col(c) for c in q.values()], threshold, protein_threshold)
    named = rows.select(*RUN, *PEPTIDE, "apex", "score", (F.col("end") - F.col("start")).alias("width"), "coelution", good.alias("_good"))
    peptides = named.filter("_good").select("peptide").distinct()
    used = named.filter(F.col("_good") | F.col("decoy")).filter("coelution > 0").join(peptides, "peptide", "left_semi")
    mapped = local_fit.apply_curves(used, curves, RUN, "apex", "library_rt", inverse=True)
    return align.consensus(mapped, PEPTIDE, "library_rt", "width", "score", "file_name")


def least_q() -> Column:
    return F.least("run_precursor_q", "run_peptide_q", "exp_precursor_q", "exp_peptide_q")


def accepted(rows: DataFrame, threshold: float) -> DataFrame:
    """peptide, charge of targets that pass at any level in any run."""
    return rows.filter(~F.col("decoy") & (least_q() <= threshold)).select(*PRECURSOR).distinct()


def consensus_points(rows: DataFrame, agreed: DataFrame, threshold: float) -> DataFrame:
    """file_name, library_rt, apex of targets that pass over all runs, with the place of their peptide."""
    good = rows.filter(~F.col("decoy") & (F.greatest("exp_precursor_q", "exp_peptide_q") <= threshold))
    return good.select(*RUN, "peptide", "apex").join(agreed.filter(~F.col("decoy")).select("peptide", "library_rt"), "peptide")


def refitted(points: DataFrame, curves: DataFrame, bandwidth: float = 0.3) -> DataFrame:
    """Stored curves fitted to consensus places; runs with fewer than LEAST_POINTS keep theirs."""
    again = local_fit.fit_curves(points, RUN, "library_rt", "apex", bandwidth, LEAST_POINTS).select(*RUN, "knots", "fitted", "mad")
    return stored(again.unionByName(curves.select(*RUN, "knots", "fitted", "mad").join(again.select(*RUN), RUN, "left_anti")), "refitted")


def tolerances(points: DataFrame, agreed: DataFrame, curves: DataFrame, before: DataFrame) -> DataFrame:
    """file_name, tolerance: what peptides differ by between runs, as the median over peptides, within what the run's curve allows.

    A curve allows three standard deviations of its points, those far off left out, and no more than the curve before it did.
    """
    wide = lambda mad: F.greatest(mad * MAD_SD * COVER, F.lit(NARROWEST))
    spread = stats.order_statistics(agreed.filter(~F.col("decoy") & F.col("mad").isNotNull()).select(F.lit(1).alias("all"), "mad"), ["all"], "mad", stats.MIDDLE)
    own = spread.agg(F.coalesce(F.max((F.col("_below") + F.col("_above")) / 2), F.lit(PLAIN_MAD)).alias("own"))  # one row, without peptides too
    off = stored(local_fit.apply_curves(points, curves, RUN, "library_rt", "expected").select(*RUN, F.abs(F.col("apex") - F.col("expected")).alias("off")), "consensus_residuals")
    raw = stats.order_statistics(off, RUN, "off", stats.MIDDLE).select(*RUN, ((F.col("_below") + F.col("_above")) / 2 * MAD_SD * COVER).alias("clip"))
    clipped = stats.clipped_mad(off.join(raw, RUN), RUN, "off", F.col("clip")).select(*RUN, wide(F.col("mad")).alias("now"))
    cap = before.select(*RUN, wide(F.col("mad")).alias("cap")).join(clipped, RUN, "left")
    ceiling = F.least(F.coalesce("now", "cap"), "cap")
    return cap.crossJoin(F.broadcast(own)).select(*RUN, F.least(wide(F.col("own")), ceiling).alias("tolerance"))


def planned(rows: DataFrame, agreed: DataFrame, items: DataFrame, curves: DataFrame, allowed: DataFrame) -> DataFrame:
    """file_name, entry_id, action, apex, start, end of each detection of an accepted item: keep, move or force.

    Of peaks as near as each other, to a billionth, the first stored counts.
    """
    used = rows.select(*RUN, "entry_id", *PEPTIDE, "charge", "apex", "start", "end", "candidates").join(items, PRECURSOR, "left_semi")
    met = used.join(agreed.select(*PEPTIDE, "library_rt", "width"), PEPTIDE).join(allowed, RUN)
    met = local_fit.apply_curves(met, curves, RUN, "library_rt", "expected")
    off = lambda at: F.abs(at - F.col("expected"))
    near = F.filter(F.transform("candidates", lambda c, i: F.struct(F.round(off(c.apex), 9).alias("off"), i.alias("i"), c.alias("c"))), lambda c: c.off <= F.col("tolerance"))
    best = F.array_min(F.transform(near, lambda c: F.struct(c.off.alias("off"), c.i.alias("i"), c.c.apex.alias("apex"), c.c.start.alias("start"), c.c.end.alias("end"))))
    met = met.withColumn("_best", best)
    peak = lambda action, apex, start, end: F.struct(F.lit(action).alias("action"), apex.cast("double").alias("apex"), start.cast("double").alias("start"), end.cast("double").alias("end"))
    keep, move = peak("keep", F.col("apex"), F.col("start"), F.col("end")), peak("move", F.col("_best.apex"), F.col("_best.start"), F.col("_best.end"))
    half, expected = F.col("width") / 2, F.col("expected")
    chosen = F.when(off(F.col("apex")) <= F.col("tolerance"), keep).when(F.col("_best").isNotNull(), move).otherwise(peak("force", expected, expected - half, expected + half))
    return met.select(*RUN, "entry_id", chosen.alias("p")).select(*RUN, "entry_id", "p.*")


def filled(rows: DataFrame, agreed: DataFrame, items: DataFrame, curves: DataFrame, library: DataFrame, windows: DataFrame, bin_width: float = 25.0) -> DataFrame:
    """file_name, entry_id, action (fill), apex, start, end of accepted items, and of their decoys, in the runs that lack them.

    An item's missing runs are the difference of two sets of runs. They are kept where a window of the run holds the item's
    precursor and the run has a curve.
    """
    runs = curves.agg(F.collect_set("file_name").alias("_all"))  # a name per run
    present = rows.filter(~F.col("decoy")).join(items, PRECURSOR, "left_semi").groupBy(*PRECURSOR).agg(F.collect_set("file_name").alias("_here"))
    missing = present.crossJoin(F.broadcast(runs)).select(*PRECURSOR, F.explode(F.array_except("_all", "_here")).alias("file_name"))
    targets = library.filter(~F.col("decoy")).select(*PRECURSOR, "precursor_mz")
    wanted = missing.join(targets, PRECURSOR)
    covered = range_join(wanted, windows.select(*RUN, "low", "high"), "precursor_mz", "low", "high", bin_width, keys=RUN).select(*RUN, *PRECURSOR).distinct()
    placed = covered.join(agreed.filter(~F.col("decoy")).select("peptide", "library_rt", "width"), "peptide")
    placed = local_fit.apply_curves(placed, curves, RUN, "library_rt", "expected").join(library.select("entry_id", *PRECURSOR), PRECURSOR)
    half = F.col("width") / 2
    return placed.select(*RUN, "entry_id", F.lit("fill").alias("action"), F.col("expected").alias("apex"), (F.col("expected") - half).alias("start"), (F.col("expected") + half).alias("end"))


def reconcile(rows: DataFrame, curves: DataFrame, library: DataFrame, windows: DataFrame, threshold: float = 0.01, protein_threshold: float = 0.0, refit: bool = True) -> DataFrame:
    """file_name, entry_id, action (keep, move, force, fill), apex, start, end of all accepted items in all runs with a curve."""
    agreed = stored(consensus(rows, curves, threshold, protein_threshold), "consensus")
    points = stored(consensus_points(rows, agreed, threshold), "consensus_points")
    now = refitted(points, curves) if refit else curves
    allowed = stored(tolerances(points, agreed, now, curves), "tolerances")
    items = stored(accepted(rows, threshold), "accepted")
    return planned(rows, agreed, items, now, allowed).unionByName(filled(rows, agreed, items, now, library, windows))
