from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import kernels
from tidewell.operators import acquisition, fdr, local_fit, models, stats


def test_counts_stand_for_rows():
    scores, decoy, counts = np.array([0.0, 1.0, 2.0, 1.0, 2.0, 3.0]), np.array([True] * 3 + [False] * 3), np.array([9, 5, 1, 3, 7, 40])
    grid = np.linspace(0, 3, 20)
    assert kernels.error_chances(grid, scores, decoy, counts) == pytest.approx(kernels.error_chances(grid, np.repeat(scores, counts), np.repeat(decoy, counts)))


def test_hot_score(spark):
    """A score of more than a million rows counts in full."""
    n = F.col("id")
    rows = spark.range(3_200_000).select(F.when(n < 3_000_000, 1.0).otherwise((n % 100) / 25.0).alias("score"), (n % 8 == 0).alias("decoy"))
    cells = rows.groupBy("score", "decoy").count().toPandas()
    grid = np.linspace(0, 99 / 25, models.GRID)
    at = np.round(cells["score"].to_numpy() / (99 / 25 / (models.GRID - 1))).astype(int)
    expected = kernels.error_chances(grid, grid[at], cells["decoy"].to_numpy(bool), cells["count"].to_numpy())
    got = {round(r.score, 6): r.pep for r in models.error_chances(rows).select("score", "pep").distinct().collect()}
    assert got == pytest.approx({round(float(s), 6): expected[i] for s, i in zip(cells["score"], at, strict=True)}, abs=1e-9)


def test_chances_depend_on_shares_only(spark):
    """Ten times the rows of each score give nearly the same chances (the densities' width shrinks with the root's fifth power)."""
    pick = np.random.default_rng(3)
    scores = np.concatenate((pick.normal(0, 1, 4000), pick.normal(3, 1, 4000)))
    decoy = np.arange(8000) < 4000
    grid = np.linspace(-3, 6, 200)
    once = kernels.error_chances(grid, scores, decoy)
    many = kernels.error_chances(grid, scores, decoy, np.full(8000, 10))
    assert np.abs(once - many).max() < 0.1
    assert kernels.error_chances(grid, scores, np.ones(8000, bool)).min() == 1.0
    assert kernels.error_chances(grid, scores, np.zeros(8000, bool)).min() == 1.0


def brute_loess(x, y, bandwidth, passes=2):
    """Local lines at each point from all points, by weighted least squares."""
    n, k, robust = len(x), max(int(np.ceil(bandwidth * len(x))), 3), np.ones(len(x))
    for _ in range(passes + 1):
        fitted = np.empty(n)
        for i in range(n):
            near = np.argsort(np.abs(x - x[i]), kind="stable")[:k]
            far = np.abs(x[near] - x[i]).max()
            w = robust[near] * (1 - np.clip(np.abs(x[near] - x[i]) / far, 0, 1) ** 3) ** 3
            a = np.stack([np.ones(k), x[near] - x[i]], axis=1)
            fitted[i] = np.linalg.lstsq(a * np.sqrt(w)[:, None], y[near] * np.sqrt(w), rcond=None)[0][0]
        off = np.abs(y - fitted)
        robust = (1 - np.clip(off / (6 * np.median(off)), 0, 1) ** 2) ** 2
    return fitted


def test_curves_equal_brute_force(spark):
    """Up to MAX_KNOTS points a curve is the local regression itself, outliers and all."""
    pick = np.random.default_rng(2)
    x = np.sort(pick.uniform(0, 50, 120))
    y = np.sin(x / 8) * 10 + pick.normal(0, 0.5, 120) + np.where(np.arange(120) % 17 == 0, 30.0, 0.0)
    points = spark.createDataFrame([("r", float(a), float(b)) for a, b in zip(x, y)], "run string, x double, y double")
    got = local_fit.fit_curves(points, ["run"], "x", "y").first()
    want = brute_loess(x, y, 0.3)
    assert got.fitted == pytest.approx(want, abs=1e-6)
    off = np.abs(y - want)
    assert (got.mad, got.sd, got.n) == (pytest.approx(np.median(off), abs=1e-6), pytest.approx(off.std(ddof=1), abs=1e-6), 120)


def test_spread_of_many_points(spark):
    """Residuals are those of the points, however many there are."""
    pick = np.random.default_rng(1)
    x = pick.uniform(0, 100, 20_000)
    noise = pick.normal(0, 5, 20_000)
    points = spark.createDataFrame([("r", float(a), float(2 * a + b)) for a, b in zip(x, noise)], "run string, x double, y double")
    curves = local_fit.fit_curves(points, ["run"], "x", "y")
    got = curves.first()
    assert got.n == 20_000 and len(got.knots) <= local_fit.MAX_KNOTS
    assert got.mad == pytest.approx(np.median(np.abs(noise)), rel=0.02) and got.sd == pytest.approx(np.abs(noise).std(ddof=1), rel=0.02)
    assert np.abs(np.array(got.fitted) - 2 * np.array(got.knots)).max() < 1
    one = local_fit.local_tolerance(points.limit(50), curves, ["run"], "x", 3.0, 0.5).collect()
    assert all(3 * 2.5 < r.tolerance < 3 * 5.5 for r in one)


def test_order_statistics(spark):
    """Ties, hot values, nulls, null keys and wide ranges; places as of a sorted list."""
    pick = np.random.default_rng(6)
    rows = [("a", float(v)) for v in pick.normal(0, 1, 3000)] + [("b", 7.0)] * 500 + [("b", float(v)) for v in range(100)] + [(None, 1e12), (None, -1e12), (None, 3.0), ("c", None), ("d", 1.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    places = {"low": lambda n: stats.nearest_rank(n, 0.2), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}
    for bins in (4096, 3):
        got = {r.k: (r.low, r.mid, r.top) for r in stats.order_statistics(df, ["k"], "v", places, bins=bins).collect()}
        want = {}
        for k in ("a", "b", None, "d"):
            v = sorted(x for key, x in rows if key == k and x is not None)
            want[k] = (v[int(0.2 * (len(v) - 1) + 0.5)], v[len(v) // 2], v[-1])
        assert got == want


def test_isotopes_equal_convolution(spark):
    """The distribution of a molecule from those of its atoms, one after another."""
    atoms = {"c": 12, "h": 20, "n": 3, "o": 5, "s": 2}
    whole = np.ones(1)
    single = {e: [1 - p, p] for e, p in acquisition.HEAVY.items()} | {e: [1 - a - b, a, b] for e, (a, b) in acquisition.HEAVY_TWO.items()}
    for e, n in atoms.items():
        for _ in range(n):
            whole = np.convolve(whole, single[e])
    row = spark.range(1).select(F.struct(*[F.lit(n).alias(e) for e, n in atoms.items()]).alias("a")).select(acquisition.isotope_distribution(F.col("a")).alias("d")).first()
    assert row.d == pytest.approx(whole[:5] / whole[:5].sum(), abs=1e-9)


def test_score_scale(spark):
    """After it, the last accepted target is at 0 and the decoys' median at -1."""
    rows = [(i, False, 10.0 + i) for i in range(50)] + [(i, True, float(i % 7)) for i in range(51)]
    df = spark.createDataFrame(rows, "base long, decoy boolean, score double")
    got = {(r.base, r.decoy): r.score for r in models.normalized(df).collect()}
    assert min(v for (b, d), v in got.items() if not d) == 0.0
    assert np.median([v for (b, d), v in got.items() if d]) == pytest.approx(-1.0)
    same = df.filter("decoy")
    assert sorted(r.score for r in models.normalized(same).collect()) == sorted(r.score for r in same.collect())


def test_calibration_chances():
    """The decoys' share weighs in, and a higher score never has a higher chance."""
    pick = np.random.default_rng(9)
    scores, decoy = np.concatenate((pick.normal(0, 1, 500), pick.normal(2.5, 1, 1500))), np.arange(2000) < 500
    grid = np.linspace(-3, 6, 300)
    got = kernels.calibration_chances(grid, scores, decoy)

    def height(values):
        width = values.std(ddof=1) * (4 / (3 * len(values))) ** 0.2
        return np.exp(-(((grid[:, None] - values) / width) ** 2) / 2).sum(axis=1) / (len(values) * width * np.sqrt(2 * np.pi))

    bad, good = height(scores[decoy]) * 0.25, height(scores[~decoy]) * 0.75
    want = np.maximum.accumulate((bad / (bad + good))[::-1])[::-1]
    assert np.abs(got - want).max() < 0.02 and (np.diff(got) <= 1e-12).all()
    assert kernels.calibration_chances(grid, scores, np.zeros(2000, bool)).min() == 1.0


def test_discriminant(spark):
    """Two measures together separate better than the first alone; a measure that misleads has no weight."""
    pick = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        for d in (False, True):
            good = not d and i % 3
            rows.append((i, d, f"p{i}", float(pick.normal(1.5 * bool(good), 1)), float(pick.normal(3.0 * bool(good), 1)), float(pick.normal(-1.0 * bool(good), 1))))
    df = spark.createDataFrame(rows, "base long, decoy boolean, peptide string, a double, b double, c double")
    scored = models.discriminant_scores(df, ["a", "b", "c"], threshold=0.05)
    assert sorted(scored.columns) == ["base", "decoy", "peptide", "score"] and scored.count() == 3000

    def accepted(score):
        best = scored.join(df.select("base", "decoy", "a"), ["base", "decoy"]).select("base", "decoy", score.alias("score"))
        return fdr.accepted_targets(fdr.compete(best, ["base"]), ["base"], 0.05).count()

    assert accepted(F.col("score")) > 1.3 * accepted(F.col("a"))
    both = scored.join(df, ["base", "decoy", "peptide"]).select("score", "a", "b", "c").toPandas()
    weights = np.linalg.lstsq(both[["a", "b", "c"]].to_numpy(), both["score"].to_numpy(), rcond=None)[0]
    assert weights[2] == pytest.approx(0, abs=1e-9) and weights[1] > weights[0] > 0 and weights @ weights == pytest.approx(1)
