"""Double counts of small keys in one array, of large ones in rounds, against the greedy rule."""

from __future__ import annotations

import random

import pytest

from tidewell.operators import acquisition as A

ROW = "k long, id string, at double, f array<double>, price double, more string"


def greedy(rows, share):
    out = set()
    for key in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (-(r[4] if r[4] is not None else float("-inf")), r[1])):
            if not any(key is not None and abs(k[2] - r[2]) <= 2 and share(k[3], r[3]) for k in kept):
                kept.append(r)
        out |= {r[1] for r in kept}
    return out


@pytest.mark.parametrize("tolerance", [None, 0.3])
@pytest.mark.parametrize("most", [512, 12, 0])
def test_equal_to_the_greedy_rule(spark, monkeypatch, tolerance, most):
    names, plain = [], A.stored
    monkeypatch.setattr(A, "stored", lambda df, name: names.append(name) or plain(df, name))
    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(9), *[9] * 5]), f"r{i}", rnd.uniform(0, 9), [rnd.randrange(6) + rnd.choice([0.0, 0.25]) for _ in range(rnd.randrange(1, 4))], rnd.choice([None, 1.0, 2.0, 3.5, 7.0]), f"m{i}") for i in range(150)]
    near = lambda a, b: sum(any(abs(x - y) <= tolerance for x in a) for y in b) if tolerance else len(set(a) & set(b))
    share = lambda a, b: near(a, b) >= -(-min(len(a), len(b)) // 2)
    df = spark.createDataFrame(rows, ROW).repartition(3)
    got = A.without_double_counts(df, ["k"], "id", "at", "f", "price", 2.0, tolerance=tolerance, unit="absolute", most=most)
    assert got.columns == df.columns
    got = got.collect()
    assert len(got) == len({r.id for r in got}) and {r.id for r in got} == greedy(rows, share) and all(r.more == "m" + r.id[1:] for r in got)
    assert ("better_pairs" in names) == (most < 512)  # no pairs are stored for keys of few rows
