"""Models fitted on the best row of each pair's sides over many runs, and scores by the mean of the folds' weights."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell.operators import models


def test_best_rows_and_mean_weights(spark):
    rng = np.random.default_rng(5)
    rows = []
    for run in "abc":
        for pair in range(300):
            for decoy in (False, True):
                good = not decoy and pair % 3
                x, y = rng.normal(2.0 if good else 0.0, 1), rng.normal(1.5 if good else 0.0, 1)
                rows.append((run, pair, f"p{pair // 2}", decoy, float(x), float(y), float(rng.normal())))
    df = spark.createDataFrame(rows, "run string, base long, peptide string, decoy boolean, x double, y double, z double")
    features = ["x", "y", "z"]
    got = models.score(df, features, threshold=0.05, best="x", averaged=True).toPandas().sort_values(["run", "base", "decoy"]).reset_index(drop=True)
    assert len(got) == len(rows) and "_best" not in got and not set(features) & set(got)

    whole = df.toPandas().sort_values(["run", "base", "decoy"]).reset_index(drop=True)
    standard = whole.copy()
    standard[features] = (whole[features] - whole[features].mean()) / whole[features].std(ddof=0)
    standard["fold"] = got["fold"]
    best = standard.sort_values("x", ascending=False).drop_duplicates(["base", "decoy"])
    weights = []
    for held in range(models.FOLDS):
        part = best[best["fold"] != held].sort_values(["base", "decoy", *features])
        weights.append(models._train(part[features].to_numpy(), part["decoy"].to_numpy(), part["fold"].to_numpy(int), 0.05))
    mean = np.mean(weights, axis=0)
    assert got["score"].to_numpy() == pytest.approx(standard[features].to_numpy() @ mean[:-1] + mean[-1], abs=1e-6)
    right = got["score"].to_numpy()
    assert right[~got["decoy"] & (got["base"] % 3 > 0)].mean() > right[got["decoy"]].mean() + 1

    held = models.score(df, features, threshold=0.05, best="x").toPandas().sort_values(["run", "base", "decoy"]).reset_index(drop=True)
    each = np.array([standard[features].to_numpy()[i] @ weights[f][:-1] + weights[f][-1] for i, f in enumerate(held["fold"])])
    assert held["score"].to_numpy() == pytest.approx(each, abs=1e-6)
