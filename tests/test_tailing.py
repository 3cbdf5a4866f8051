"""Fits of tailing peaks: known shapes come back, no step nearby is better, limits equal the summed density."""

from __future__ import annotations

import numpy as np

from tidewell.functions import tailing
from tidewell.operators import peaks


def plain_density(x, mu, sigma, tau):
    """The convolution itself, by a fine sum over the exponential."""
    t = (np.arange(40_000) + 0.5) * tau / 1000
    return np.array([(np.exp(-((v - t - mu) ** 2) / 2 / sigma**2) / sigma / np.sqrt(2 * np.pi) * np.exp(-t / tau) / tau).sum() * tau / 1000 for v in x])


SHAPES = [(5.0, 0.3, 0.4, 100.0), (5.0, 0.5, 0.05, 3.0), (20.0, 0.2, 2.0, 1e6), (-3.0, 1.0, 1.0, 0.5), (7.0, 0.4, 0.8, 10.0)]


def test_density_is_the_convolution():
    for mu, sigma, tau, _ in SHAPES:
        x = np.linspace(mu - 4 * sigma, mu + 4 * sigma + 6 * tau, 60)
        assert np.allclose(tailing.density(x, mu, sigma, tau), plain_density(x, mu, sigma, tau), rtol=2e-3, atol=1e-6)


def test_known_shapes_come_back(spark):
    rng, rows = np.random.default_rng(4), []
    for n, (mu, sigma, tau, area) in enumerate(SHAPES):
        x = np.sort(rng.uniform(mu - 5 * sigma, mu + 5 * sigma + 8 * tau, 60 + 20 * n))
        rows += [(n, float(a), float(area * b)) for a, b in zip(x, plain_density(x, mu, sigma, tau))]
    rows += [(90, float(i), 0.0) for i in range(9)] + [(91, 1.0, 2.0)] * 3 + [(92, 1.0, float(i)) for i in range(9)] + [(93, None, 1.0)] * 9
    df = spark.createDataFrame(rows, "series long, x double, y double").repartition(3)
    got = {r.series: r for r in peaks.tailing_fit(df, ["series"], "x", "y").collect()}
    assert set(got) == set(range(len(SHAPES)))
    for n, (mu, sigma, tau, area) in enumerate(SHAPES):
        r = got[n]
        assert r.r_squared > 0.9999
        assert abs(r.mu - mu) < 0.01 * (sigma + tau) and abs(r.sigma / sigma - 1) < 0.01 and abs(r.area / area - 1) < 0.01
        assert abs(r.tau / tau - 1) < 0.01 or tau < 0.2 * sigma and abs(r.tau - tau) < 0.02 * sigma
        grid = np.linspace(mu - 10 * sigma - 5 * tau, mu + 10 * sigma + 25 * tau, 400_001)
        share = np.cumsum(tailing.density(grid, r.mu, r.sigma, r.tau)) * (grid[1] - grid[0])
        for place, want in ((r.start, 0.025), (r.end, 0.975)):
            assert abs(np.interp(place, grid, share) - want) < 1e-4
    assert peaks.tailing_fit(df.limit(0), ["series"], "x", "y").count() == 0


def test_no_step_nearby_is_better():
    """With noise, and over two peaks: random steps of all sizes around the fit never lower the squares by more than a trifle."""
    rng = np.random.default_rng(7)
    x = np.broadcast_to(np.linspace(0, 12, 100), (4, 100)).copy()
    y = np.stack([100 * tailing.density(x[0], 4, 0.4, 0.7) + rng.normal(0, 1, 100), np.exp(-((x[0] - 5) ** 2)), rng.uniform(0, 1, 100), np.exp(-((x[0] - 3) ** 2)) + 0.5 * np.exp(-((x[0] - 8) ** 2) / 2)])
    found = tailing.fit(x, y, np.ones(x.shape, bool))
    for i in range(4):
        mu, sigma, tau, area, r2 = found[i]
        squares = lambda m, s, t, a: ((a * tailing.density(x[i], m, s, t) - y[i]) ** 2).sum()  # noqa: B023, E731
        best = squares(mu, sigma, tau, area)
        assert abs(1 - best / ((y[i] - y[i].mean()) ** 2).sum() - r2) < 1e-9
        for _ in range(2000):
            size = 10 ** rng.uniform(-5, -1)
            steps = rng.normal(0, size, 4)
            assert squares(mu + steps[0] * sigma, sigma * np.exp(steps[1]), tau * np.exp(steps[2]), area * np.exp(steps[3])) > best * (1 - 1e-6)
