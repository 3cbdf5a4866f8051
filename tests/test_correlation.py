"""Cross-correlation over blocks of spectra against a plain loop, and how much is shuffled for a pair."""

from __future__ import annotations

import random

import pytest

from tidewell.operators import correlation as C


def plain(peaks: list[tuple[float, float]], places: list[float]) -> float:
    bin_of = lambda mz: int(mz / C.WIDTH + 1 - C.OFFSET)
    x, n = {}, C.n_bins()
    for mz, y in peaks:
        if 0 <= mz < C.TOP:
            x[bin_of(mz)] = x.get(bin_of(mz), 0.0) + y**0.5
    span, whole = n // C.WINDOWS + 1, max(x.values(), default=0.0)
    kept = {b: C.HEIGHT * v / max(w for a, w in x.items() if a // span == b // span) for b, v in x.items() if v > C.NOISE * whole}
    score = 0.0
    for b in {bin_of(mz) for mz in places if 0 <= mz < C.TOP}:
        score += kept.get(b, 0.0) - sum(v for a, v in kept.items() if a != b and abs(a - b) <= C.REACH) / C.AROUND
    return score * C.SCALE


@pytest.mark.parametrize("blocks", [(C.BLOCK_BINS, C.CELL_PAIRS, C.LOOKED_UP), (5000, 7, 11)])
def test_equal_to_a_loop(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_BINS", "CELL_PAIRS", "LOOKED_UP"), blocks, strict=True):
        monkeypatch.setattr(C, name, value)
    rnd = random.Random(3)
    spectra = {(run, scan): [(rnd.uniform(-50, 2100), rnd.uniform(0, 90) if rnd.random() < 0.9 else 0.001) for _ in range(rnd.randrange(1, 80))] for run in "ab" for scan in range(9)}
    spectra["a", 0] = [(2500.0, 4.0)]
    entries = {e: [rnd.uniform(0, 2050) for _ in range(rnd.randrange(1, 9))] for e in range(30)} | {40: [3000.0], 42: [0.0, 1999.999, 1999.998]}
    pairs = [(*s, e, rnd.random()) for s in [*spectra, ("c", 1)] for e in [*entries, 41] if rnd.random() < 0.7] + [("a", 1, 3, 0.5), ("a", 1, 3, 0.5), ("a", 1, None, 0.1), (None, 1, 3, 0.2)]
    df = spark.createDataFrame(pairs, "run string, scan long, entry long, x double").repartition(3)
    peaks = spark.createDataFrame([(*s, *p) for s, v in spectra.items() for p in v] + [(None, 1, 500.0, 9.0)], "run string, scan long, mz double, y double")
    fragments = spark.createDataFrame([(e, mz) for e, v in entries.items() for mz in v], "entry long, mz double")
    got = C.cross_correlation(df, fragments, peaks, ["run", "scan"], "entry", "mz", "y")
    assert got.columns == [*df.columns, "xcorr"]
    want = [(*p, plain(spectra.get(p[:2], []), entries.get(p[2], []))) for p in pairs]
    order = lambda rows: sorted(((str(r[:4]), r[4]) for r in rows))
    for (a, x), (b, y) in zip(order(tuple(r) for r in got.collect()), order(want), strict=True):
        assert a == b and x == pytest.approx(y, abs=1e-9)
    assert C.cross_correlation(df.limit(0), fragments, peaks, ["run", "scan"], "entry", "mz", "y").count() == 0
    assert {r.xcorr for r in C.cross_correlation(df, fragments, peaks.limit(0), ["run", "scan"], "entry", "mz", "y").collect()} == {0.0}


def test_a_row_for_each_pair(spark):
    """No join makes a row for each bin of a pair."""
    pairs = spark.range(40).selectExpr("id % 4 AS scan", "id AS entry")
    fragments = spark.range(40).selectExpr("id AS entry", "explode(transform(sequence(1, 50), i -> i * 20.0D)) AS mz")
    peaks = spark.range(400).selectExpr("id % 4 AS scan", "id * 4.0D AS mz", "1.0D AS y")
    out = C.cross_correlation(pairs, fragments, peaks, ["scan"], "entry", "mz", "y")
    assert out.count() == 40 and "_bins" not in out.columns
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_bins" in plan and "Window" not in plan and plan.count("Join") == 3
