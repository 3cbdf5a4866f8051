"""Polish features against loops, rated levels against their parts, bracketed masses and order statistics against plain Python."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import kernels, sequences
from tidewell.operators import fdr, features, models, peaks, stats


def plain_features(y, expected):
    """The features cell by cell."""
    overall, rows, cols, rest = kernels.median_polish(y)
    n, m = y.shape
    model = [[math.exp(overall + rows[i] + cols[j]) for j in range(m)] for i in range(n)]
    shown = [[y[i][j] > 0 for j in range(m)] for i in range(n)]

    def share(pairs):
        mean = sum(o for o, _ in pairs) / len(pairs)
        total = sum((o - mean) ** 2 for o, _ in pairs)
        return 0.0 if total < 1e-30 else max(0.0, 1 - sum((o - p) ** 2 for o, p in pairs) / total)

    level = [math.sqrt(math.exp(overall + rows[i])) if any(shown[i]) else 0.0 for i in range(n)]
    ideal = [math.sqrt(e) for e in expected]
    cosine = sum(a * b for a, b in zip(level, ideal)) / math.sqrt(sum(a * a for a in level) * sum(b * b for b in ideal))
    root = lambda i, j: (math.sqrt(y[i][j]), math.sqrt(model[i][j]))
    least = []
    for i in range(n):
        pairs = [root(i, j) for j in range(m) if shown[i][j]]
        least.append(share(pairs) if len(pairs) >= 3 else 0.0)
    together = []
    for i in range(n):
        for j in range(i + 1, n):
            both = [(rest[i][k], rest[j][k]) for k in range(m) if shown[i][k] and shown[j][k]]
            if len(both) >= 3:
                a, b = (np.array(v) for v in zip(*both))
                with np.errstate(invalid="ignore"):
                    r = np.corrcoef(a, b)[0, 1] if a.std() > 1e-15 and b.std() > 1e-15 else 0.0
                together.append(r)
    filled = [[y[i][j] if shown[i][j] else 1e-4 for j in range(m)] for i in range(n)]
    ratio = sum(abs(filled[i][j] - model[i][j]) for i in range(n) for j in range(m)) / sum(map(sum, filled))
    return [cosine, min(1.0, share([root(i, j) for i in range(n) for j in range(m)])), ratio, min(least), float(np.mean(together)) if together else 0.0]


def test_polish_features(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for g in range(6):
        n, m = int(rng.integers(2, 7)), int(rng.integers(3, 12))
        y = np.outer(rng.uniform(1, 9, n), rng.uniform(1, 9, m)) * rng.lognormal(0, 0.3, (n, m)) * (rng.uniform(size=(n, m)) > 0.15)
        y[0, 0], y[-1, -1] = 1.0, 1.0
        y[:, 0], y[0, :] = np.maximum(y[:, 0], 0.5), np.maximum(y[0, :], 0.5)  # every row and column is there
        expected = rng.uniform(1, 9, n)
        rows += [(g, i, j, float(y[i, j]), float(expected[i])) for i in range(n) for j in range(m)]
        want[g] = plain_features(y, expected)
    df = spark.createDataFrame(rows, "g long, fragment long, scan long, y double, e double").repartition(3)
    for r in peaks.polish(df, ["g"], "fragment", "scan", "y", "e").collect():
        assert [r[n] for n in peaks.POLISH] == pytest.approx(want[r.g], abs=1e-9)


def test_rated_levels(spark):
    rnd = random.Random(1)
    rows = [(run, b, d, f"p{b // 2}", rnd.gauss(0 if d else b % 3, 1), n) for n, (run, b, d) in enumerate((r, b, d) for r in "xy" for b in range(60) for d in (False, True) if rnd.random() < 0.9)]
    df = spark.createDataFrame(rows, "run string, base long, decoy boolean, peptide string, score double, id long")
    levels = ["run_precursor_q", "run_peptide_q", "exp_precursor_q", "exp_peptide_q"]
    got = {r.id: r for r in features.rated_levels(df, ["id"]).collect()}
    plain = {r.id: r for r in fdr.all_levels(df, ["id"]).collect()}
    best = {(r.base, r.decoy, r.score): r.pep for r in models.error_chances(fdr.compete(df, ["base"])).collect()}
    assert len(got) == len(rows)
    for n, r in got.items():
        assert [r[c] for c in levels] == [plain[n][c] for c in levels]
        assert r.pep == pytest.approx(best.get((r.base, r.decoy, r.score), 1.0))
    only = spark.createDataFrame([(b,) for b in range(0, 60, 2)], "base long")
    some = {r.id: r for r in features.rated_levels(df, ["id"], only=only).collect()}
    half = {r.id: r for r in fdr.all_levels(df.filter("base % 2 = 0"), ["id"]).collect()}
    for n, r in some.items():
        assert [r[c] for c in levels] == ([half[n][c] for c in levels] if r.base % 2 == 0 else [1.0] * 4) and (r.base % 2 == 0 or r.pep == 1.0)
    assert set(some) == set(got)


def test_bracketed_masses(spark):
    cases = ["_PEPTC[+57.021]IDE_", "[42.01]PEP(16)", "AC[-17.5]D[Oxidation]E(1e-3)", "", "[x]", "a[++1.5]b[1.2.3]", None, "K.AB[160.03].C"]

    def plain(s):
        position, found = 0, []
        for m in re.finditer(r"([A-Za-z])|\[([^\]]*)\]|\(([^)]*)\)", s or ""):
            if m.group(1):
                position += 1
                continue
            try:
                found.append((max(position - 1, 0), float((m.group(2) or m.group(3) or "").lstrip("+"))))
            except ValueError:
                pass
        return found

    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, s string").select("i", sequences.bracketed_masses(F.col("s")).alias("m"))
    assert {r.i: [(m.position, m.mass) for m in r.m or []] for r in rows.collect()} == {i: plain(c) for i, c in enumerate(cases)}


def test_order_statistics(spark):
    rnd = random.Random(6)
    values = {"a": [rnd.gauss(0, 1) for _ in range(3000)] + [1e12], "b": [float(rnd.randrange(5)) for _ in range(700)], "c": [7.5], None: [rnd.random() * 1e-9 for _ in range(400)] + [5.0] * 300}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    places = {"first": lambda n: F.lit(0), "third": lambda n: F.floor(n / 3), "last": lambda n: n - 1, **stats.MIDDLE}
    got = {r.k: r for r in stats.order_statistics(df, ["k"], "v", places, bins=16).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        s, n = sorted(vs), len(vs)
        assert [got[k][p] for p in places] == [s[0], s[n // 3], s[-1], s[(n - 1) // 2], s[n // 2]]
