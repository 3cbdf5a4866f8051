"""Semi-supervised scoring of targets against decoys.

Folds are fitted side by side, a Spark task each, on a bounded number of pairs; all rows
are scored by column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import kernels
from tidewell.operators import fdr, stats
from tidewell.operators.dedup import best_row
from tidewell.storage import stored

FOLDS, ROUNDS, COSTS = 3, 10, (0.01, 0.1, 1.0, 10.0)
#: Rows that a fold is fitted on, about (documented bound of the sample); whole groups are drawn.
MAX_ROWS = 10_000
GRID = 1000


def _estimates(score: np.ndarray, decoy: np.ndarray) -> np.ndarray:
    order = np.lexsort((~decoy, -score))
    d, t = np.cumsum(decoy[order]), np.cumsum(~decoy[order])
    raw = np.where(t > 0, d / np.maximum(t, 1), 1.0)
    q = np.empty(len(score))
    q[order] = np.minimum(1.0, np.minimum.accumulate(raw[::-1])[::-1])
    return q


def _chosen_cost(x: np.ndarray, decoy: np.ndarray, parts: np.ndarray, use: np.ndarray, threshold: float) -> float:
    """The cost whose machines accept most targets among the rows that they weren't fitted on, the first on a tie."""
    best, most = COSTS[0], -1
    for cost in COSTS:
        accepted = 0
        for part in np.unique(parts):
            fitted = use & (parts != part)
            if decoy[fitted].all() or not decoy[fitted].any():
                continue
            w = kernels.linear_machine(x[fitted], np.where(decoy[fitted], -1.0, 1.0), cost, 42, epochs=20)
            left = parts == part
            accepted += ((_estimates(x[left] @ w[:-1], decoy[left]) <= threshold) & ~decoy[left]).sum()
        if accepted > most:
            best, most = cost, accepted
    return best


def _train(x: np.ndarray, decoy: np.ndarray, parts: np.ndarray, threshold: float) -> np.ndarray:
    """Start from the feature that separates best; then refit on the targets accepted so far until twice in turn there are no more."""
    sides = [(s * x[:, k], k, s) for k in range(x.shape[1]) for s in (1, -1)]
    score, k, s = max(sides, key=lambda c: ((_estimates(c[0], decoy) <= threshold) & ~decoy).sum())
    best = np.append(np.eye(x.shape[1])[k] * s, 0.0)
    most = ((_estimates(score, decoy) <= threshold) & ~decoy).sum()
    failed, cost = 0, None
    for _ in range(ROUNDS):
        for limit in (threshold, 0.05, 0.1, 0.25, 0.5):
            chosen = (_estimates(score, decoy) <= limit) & ~decoy
            if chosen.sum() >= 50:
                break
        use = chosen | decoy
        if not chosen.any() or not decoy.any():
            break
        cost = cost or _chosen_cost(x, decoy, parts, use, threshold)
        w = kernels.linear_machine(x[use], np.where(decoy[use], -1.0, 1.0), cost, 42, epochs=20)
        score = x @ w[:-1] + w[-1]
        now = ((_estimates(score, decoy) <= threshold) & ~decoy).sum()
        failed = 0 if now > most else failed + 1
        if now > most:
            best, most = w, now
        if failed == 2:
            break
    return best


def normalized(scored: DataFrame, threshold: float = 0.01) -> DataFrame:
    """``score`` less that of the last accepted target, by the distance from there to the decoys' median; as it is if that isn't positive.

    The accepted are the targets of the winners of each pair within ``threshold``.
    """
    rated = fdr.q_values(fdr.compete(scored, ["base"]), ["base"], fdr.TRAINING)
    last = rated.filter(~F.col("decoy") & (F.col("q") <= threshold)).agg(F.min("score").alias("_last"))
    decoys = scored.filter("decoy").select(F.lit(0).alias("_k"), "score")
    middle = stats.order_statistics(decoys, ["_k"], "score", stats.MIDDLE).agg(F.max((F.col("_below") + F.col("_above")) / 2).alias("_mid"))
    both = stored(last.crossJoin(middle), "score_scale")  # one row
    apart = F.col("_last") - F.col("_mid")
    moved = F.when(apart > 0, (F.col("score") - F.col("_last")) / apart).otherwise(F.col("score"))
    return scored.crossJoin(F.broadcast(both)).withColumn("score", moved).drop("_last", "_mid")


def _sampled(folded: DataFrame, features: list[str], base: str, group: str) -> DataFrame:
    """Rows of each fold left out (held). Whole groups are drawn by their hash, in about the share that MAX_ROWS allows."""
    share = min(1.0, MAX_ROWS * FOLDS / (FOLDS - 1) / max(folded.count(), 1))
    drawn = folded.filter(F.pmod(F.xxhash64(group), F.lit(1 << 40)) < int(share * (1 << 40)))
    return drawn.select(base, "decoy", "fold", *features, F.explode(F.array(*map(F.lit, range(FOLDS)))).alias("held")).filter("fold <> held")


def score(rows: DataFrame, features: list[str], base: str = "base", group: str = "peptide", threshold: float = 0.01, best: str | None = None, averaged: bool = False) -> DataFrame:
    """``rows`` with ``score``: each row by the model of the folds that its group isn't in. ``rows`` has ``decoy``.

    With ``best``, models are fitted on the row of each base, of targets as of decoys, that has most of it: over many runs
    most rows repeat the same few pairs, and the sample then holds more of them. With ``averaged`` all rows are scored
    by the mean of the folds' weights, so scores of different folds are on one scale; a row is then part of what its own
    model has learned from.
    """
    standard = stats.standardized(rows if best is None else rows.withColumn("_best", F.col(best)), features)
    folded = stored(standard.join(stats.folds(rows, group, FOLDS), group), "model_rows")
    fitted = folded if best is None else best_row(folded, [base, "decoy"], F.desc("_best"), *features)
    dealt = _sampled(fitted, features, base, group)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([base, "decoy", *features])
        w = _train(part[features].to_numpy(float), part["decoy"].to_numpy(bool), part["fold"].to_numpy(int), threshold)
        return pd.DataFrame({"held": [int(part["held"].iloc[0])], "w": [w]})

    models = stored(dealt.groupBy("held").applyInPandas(fit, "held int, w array<double>"), "models")
    if averaged:
        mean = models.agg(F.array(*[F.avg(F.get("w", F.lit(i))) for i in range(len(features) + 1)]).alias("w"), F.lit(0).alias("held"))
        joined = folded.crossJoin(F.broadcast(mean))  # one row
    else:
        joined = folded.join(F.broadcast(models), F.col("fold") == F.col("held"))  # a row per fold
    total = F.get("w", F.lit(len(features)))
    for i, f in enumerate(features):
        total = total + F.get("w", F.lit(i)) * F.col(f)
    return joined.withColumn("score", total).drop("w", "held", "_best", *features)


def discriminant_scores(rows: DataFrame, features: list[str], base: str = "base", group: str = "peptide", threshold: float = 0.01, rounds: int = 3) -> DataFrame:
    """``rows`` with ``score``: one linear discriminant for all, whose weights are the mean of those of the folds.

    Each fold's weights are fitted up to ``rounds`` times on the decoys and on the targets
    accepted so far; weights below 0 are 0, and their squares sum to 1. The first feature
    is where it starts, and where it stays if no fit accepts more targets.
    """
    folded = stored(rows.join(stats.folds(rows, group, FOLDS), group), "model_rows")
    dealt = _sampled(folded, features, base, group)

    def accepted(score: np.ndarray, decoy: np.ndarray) -> np.ndarray:
        return (_estimates(score, decoy) <= threshold) & ~decoy

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([base, "decoy", *features])
        x, decoy = part[features].to_numpy(float), part["decoy"].to_numpy(bool)
        best = np.eye(len(features))[0]
        chosen = accepted(x @ best, decoy)
        most = chosen.sum()
        for _ in range(rounds):
            use = chosen | decoy
            w = kernels.discriminant(x[use], ~decoy[use])
            w = None if w is None else np.maximum(w, 0)
            if w is None or not w.any():
                break
            w = w / np.linalg.norm(w)
            chosen = accepted(x @ w, decoy)
            if chosen.sum() > most:
                best, most = w, chosen.sum()
        return pd.DataFrame({"held": [int(part["held"].iloc[0])], "w": [best]})

    fitted = dealt.groupBy("held").applyInPandas(fit, "held int, w array<double>").collect()  # a row per fold
    mean = np.maximum(np.mean([r["w"] for r in fitted], axis=0), 0) if fitted else np.eye(len(features))[0]
    mean = mean / np.linalg.norm(mean)
    total = F.lit(0.0)
    for f, w in zip(features, mean, strict=True):
        total = total + F.lit(float(w)) * F.col(f)
    return folded.withColumn("score", total).drop("fold", *features)


def error_chances(winners: DataFrame, chances=kernels.error_chances) -> DataFrame:
    """``winners`` (of a competition, with score and decoy) with ``pep``: from densities on a grid of GRID scores.

    Scores are counted per cell of the grid first, so the fit sees counts, not rows.
    """
    ends = winners.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    placed = winners.crossJoin(F.broadcast(ends))  # one row
    step = F.greatest((F.col("_hi") - F.col("_lo")) / (GRID - 1), F.lit(1e-12))
    placed = placed.withColumn("_cell", F.round((F.col("score") - F.col("_lo")) / step).cast("int"))
    cells = placed.groupBy("_lo", "_hi", "_cell", "decoy").agg(F.count("*").alias("n"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        low, high = part["_lo"].iloc[0], part["_hi"].iloc[0]
        grid = np.linspace(low, high, GRID)
        at, decoy = part["_cell"].to_numpy(int), part["decoy"].to_numpy(bool)
        return pd.DataFrame({"_cell": np.arange(GRID, dtype=np.int32), "pep": chances(grid, grid[np.clip(at, 0, GRID - 1)], decoy, part["n"].to_numpy(int))})

    table = cells.groupBy("_lo", "_hi").applyInPandas(fit, "_cell int, pep double")
    return placed.join(F.broadcast(table), "_cell").drop("_cell", "_lo", "_hi")  # GRID rows


def experiment(rows: DataFrame, features: list[str], base: str = "base", group: str = "peptide") -> DataFrame:
    """base, decoy, score, q, pep of the winners over all runs, scored by ``features``."""
    scored = stored(score(rows, features, base, group), "scored")
    return error_chances(fdr.experiment_q_values(scored.select(F.col(base).alias("base"), "decoy", "score")))
