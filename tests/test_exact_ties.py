"""Weighted medians of keys whose weight is halved exactly, but for how sums are rounded."""

from __future__ import annotations

import math
import random
from itertools import accumulate

from tidewell.operators import stats


def test_medians_add_up_in_the_order_of_values(spark):
    """Weights come in pairs that make 1, so that half of the whole is often reached up to the last digit."""
    rnd, rows, want = random.Random(11), [], {}
    for key in range(4000):
        weights = [1 / (1 + math.exp(-s)) for s in (rnd.randrange(-5, 6) / 5 for _ in range(6)) for s in (s, -s)]
        rnd.shuffle(weights)
        upto = list(accumulate(weights))
        want[key] = next(i for i, u in enumerate(upto) if u * 2 >= upto[-1])
        rows += [(key, i, w) for i, w in enumerate(weights)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v long, w double").repartition(7)
    assert {r.k: r.median for r in stats.weighted_median(df, ["k"], "v", "w").collect()} == want
    few = df.filter("k < 50")
    wide = few.unionByName(few.filter("k = 0").selectExpr("-1L AS k", "v", "1.0D AS w"))
    got = {r.k: r.median for r in stats.weighted_median(wide, ["k"], "v", "w", most=11).collect()}  # all by ranges
    assert got[-1] == 5 and got.keys() == {-1, *range(50)}
    mixed = wide.filter("k > 0 OR v < 4")
    got = {r.k: r.median for r in stats.weighted_median(mixed, ["k"], "v", "w", most=11).collect()}  # two of them not
    assert got[-1] == 1 and got.keys() == {-1, *range(50)}
    nulls = spark.createDataFrame([(1, None, 1.0), (1, 5, 1.0), (1, 7, 1.0), (None, 3, 1.0)], "k long, v long, w double")
    assert {r.k: r.median for r in stats.weighted_median(nulls, ["k"], "v", "w").collect()} == {1: 7, None: 3}
