"""Target-decoy competition and q-values.

Rows carry an id of the pair (``base``), a class (``decoy``, boolean) and a ``score``.
Estimates follow the rank by score, best first, with ties in the order of ``base``.
Everything below works on columns of these names; rename before if yours differ.

Ranks, of the experiment or of a run, are running sums over all rows. They are made in two
steps, totals of score ranges first and rows within a range second, so none lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import ranges
from tidewell.storage import stored

#: (numerator correction, least denominator) of the estimates: reported, training, calibration.
REPORTED, TRAINING, CALIBRATION = "reported", "training", "calibration"


def base_id(entry_id: Column) -> Column:
    """Pairs share all but the highest of 32 bits."""
    return entry_id.bitwiseAND(F.lit(0x7FFFFFFF))


def compete(rows: DataFrame, keys: list[str], keep_unpaired_decoys: bool = True) -> DataFrame:
    """One row per ``keys``: the better of target and decoy, the decoy on a tie. Columns: keys, score, decoy."""
    best = rows.groupBy(*keys).agg(F.max(F.when(~F.col("decoy"), F.col("score"))).alias("t"), F.max(F.when(F.col("decoy"), F.col("score"))).alias("d"))
    target_wins = F.col("t").isNotNull() & (F.col("d").isNull() | F.coalesce(F.col("t") > F.col("d"), F.lit(False)))
    if not keep_unpaired_decoys:
        best = best.filter(F.col("t").isNotNull())
    return best.select(*keys, F.when(target_wins, F.col("t")).otherwise(F.col("d")).alias("score"), (~target_wins).alias("decoy"))


def _raw(targets: Column, decoys: Column, kind: str) -> Column:
    if kind == CALIBRATION:
        return decoys / F.greatest(targets, F.lit(1))
    return F.when(targets == 0, F.lit(1.0)).otherwise((decoys + (1 if kind == REPORTED else 0)) / targets)


def q_values(winners: DataFrame, tie: list[str], kind: str = REPORTED, partition: list[str] | None = None) -> DataFrame:
    """Adds ``q``: the least estimate at this rank or a worse one, 1 at most. ``partition``: ranks of their own, as of runs."""
    keys = list(partition or [])
    best_first = [F.col("score").desc(), *map(F.col, tie)]
    # frames that end with the partition are computed anew for each row, so the last frame runs over the reversed order
    worst_first = [F.col("score").asc(), *[F.col(t).desc() for t in tie]]
    one = F.when(F.col("decoy"), 1).otherwise(0)
    rows = ranges.with_running(ranges.ranged(winners, keys, best_first, "score_ranges"), keys, best_first, {"_t": 1 - one, "_d": one})
    raw = rows.withColumn("_raw", _raw(F.col("_t"), F.col("_d"), kind))
    raw = raw.withColumn("_least", F.min("_raw").over(W.partitionBy(*keys, ranges.PART).orderBy(*worst_first).rowsBetween(W.unboundedPreceding, 0)))
    worse = raw.groupBy(*keys, ranges.PART).agg(F.min("_raw").alias("m"))
    below = F.min("m").over(W.partitionBy(*keys).orderBy(F.col(ranges.PART).desc()).rowsBetween(W.unboundedPreceding, -1))
    both = ranges.matched(raw, worse.select(*keys, ranges.PART, below.alias("_below")), [*keys, ranges.PART])
    return both.withColumn("q", F.least(F.lit(1.0), "_least", "_below")).select(*winners.columns, "q")


def run_q_values(rows: DataFrame, run: str = "run", base: str = "base") -> DataFrame:
    """(run, base, decoy, score, q) of the winners of each run; losers have none (read it as 1)."""
    return q_values(compete(rows, [run, base]), [base], partition=[run])


def experiment_q_values(rows: DataFrame, base: str = "base") -> DataFrame:
    """(base, decoy, score, q) over all runs: each class competes by its best row."""
    return q_values(compete(rows, [base]), [base])


def _winning_rows(rows: DataFrame, keys: list[str], order: list[str], carried: list[str]) -> DataFrame:
    """As ``compete``, with the columns ``carried`` of the winner: of a class's rows the best, the first by ``order`` on a tie."""
    row = F.struct((-F.col("score")).alias("worse"), *order, *[F.col(c).alias(f"_{c}") for c in carried], F.col("score").alias("x"))
    best = rows.groupBy(*keys).agg(F.min(F.when(~F.col("decoy"), row)).alias("t"), F.min(F.when(F.col("decoy"), row)).alias("d"))
    target_wins = F.col("t").isNotNull() & (F.col("d").isNull() | F.coalesce(F.col("t.x") > F.col("d.x"), F.lit(False)))
    won = best.withColumn("w", F.when(target_wins, F.col("t")).otherwise(F.col("d")))
    return won.select(*keys, F.col("w.x").alias("score"), (~target_wins).alias("decoy"), *[F.col(f"w._{c}").alias(c) for c in carried])


def all_levels(rows: DataFrame, order: list[str], run: str = "run", base: str = "base", peptide: str = "peptide") -> DataFrame:
    """``rows`` with run_precursor_q, run_peptide_q, exp_precursor_q and exp_peptide_q.

    ``order`` names columns that tell rows apart; of equal scores the first by it counts.
    In a run, pairs compete, the winning row has its q-value and all others 1; peptides
    compete by their best row, and all their rows have the peptide's. Over the experiment
    pairs and peptides compete by their best rows of all runs, and every row has its pair's
    and its peptide's. With one run only, the experiment's are the run's.
    """
    rows = stored(rows, "rated_rows")
    one = F.lit(1.0)

    def peptides(keys: list[str]) -> DataFrame:
        first = W.partitionBy(*keys, peptide).orderBy(F.col("score").desc(), *order)
        best = rows.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
        won = _winning_rows(best, [*keys, base], order, [peptide])
        return q_values(won, [base], partition=keys).select(*keys, peptide, F.col("q").alias("_q"))

    def given(to: DataFrame, rated: DataFrame, keys: list[str], name: str) -> DataFrame:
        return to.join(rated.withColumnRenamed("_q", name), keys, "left").withColumn(name, F.coalesce(name, one))

    row = list(dict.fromkeys([run, base, "decoy", *order]))
    in_run = q_values(_winning_rows(rows, [run, base], order, [c for c in row if c not in (run, base, "decoy", "score")]), [base], partition=[run])
    out = given(rows, in_run.select(*row, F.col("q").alias("_q")), row, "run_precursor_q")
    out = given(out, peptides([run]), [run, peptide], "run_peptide_q")
    if rows.select(run).distinct().limit(2).count() < 2:
        return out.withColumn("exp_precursor_q", F.col("run_precursor_q")).withColumn("exp_peptide_q", F.col("run_peptide_q"))
    over_all = experiment_q_values(rows, base).select(base, F.col("q").alias("_q"))
    return given(given(out, over_all, [base], "exp_precursor_q"), peptides([]), [peptide], "exp_peptide_q")


def effective_q(precursor: Column, peptide: Column, protein: Column, level: str) -> Column:
    """The q-value that counts at ``level``: precursor, peptide, protein or both (the larger of the first two)."""
    choices = {"precursor": precursor, "peptide": peptide, "protein": protein, "both": F.greatest(precursor, peptide)}
    if level not in choices:
        raise ValueError(f"level is one of {', '.join(choices)}, not {level!r}")
    return choices[level]


def accepted_targets(winners: DataFrame, tie: list[str], threshold: float) -> DataFrame:
    """The best targets, as many as there are above the last rank at which decoys per target are within ``threshold``."""
    rated = q_values(winners, tie, TRAINING)
    return rated.filter(~F.col("decoy") & (F.col("q") <= threshold)).drop("q")


def counts_at(rated: DataFrame, thresholds: tuple[float, ...] = (0.001, 0.01, 0.05, 0.1)) -> DataFrame:
    """(threshold, n): rows with q up to each threshold."""
    each = [F.struct(F.lit(t).alias("threshold"), F.coalesce(F.sum(F.when(F.col("q") <= t, 1)), F.lit(0)).cast("long").alias("n")) for t in thresholds]
    return rated.agg(F.array(*each).alias("each")).select(F.inline("each"))


def best_per_peptide(rows: DataFrame, peptide: str = "peptide", order: tuple[str, ...] = ("base",)) -> DataFrame:
    """The row with the best score of each peptide, the first by ``order`` on a tie."""
    first = W.partitionBy(peptide).orderBy(F.col("score").desc(), *order)
    return rows.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def compact(rows: DataFrame, passing: DataFrame, base: str = "base") -> DataFrame:
    """Rows, targets and decoys, of pairs that pass."""
    return rows.join(passing.select(base).distinct(), base, "left_semi")


def picked_groups(members: DataFrame, scores: DataFrame, gate: float) -> DataFrame:
    """Picked competition of groups.

    ``members``: (group_id, peptide). ``scores``: (peptide, decoy, score, best_q), best row
    of each peptide and class. A group's target score is the best of its peptides with
    best_q up to ``gate``, its decoy score the best of all its decoys; the target wins a
    tie. Columns: group_id, score, decoy, q (decoys per target, 1 at most).
    """
    eligible = F.when(~F.col("decoy") & (F.col("best_q") <= gate), F.col("score"))
    sides = members.join(scores, "peptide").groupBy("group_id").agg(F.max(eligible).alias("t"), F.max(F.when(F.col("decoy"), F.col("score"))).alias("d"))
    target_wins = F.col("t").isNotNull() & (F.col("d").isNull() | F.coalesce(F.col("t") >= F.col("d"), F.lit(False)))
    winners = sides.filter(F.coalesce("t", "d").isNotNull()).select("group_id", F.when(target_wins, F.col("t")).otherwise(F.col("d")).alias("score"), (~target_wins).alias("decoy"))
    return q_values(winners, ["group_id"], TRAINING)
