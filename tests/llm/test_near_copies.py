from __future__ import annotations

import itertools
import random
import re

import numpy as np

import corpus_pipeline
from tidewell.llm import near_copies


def groups(rows, k=5):
    """A group for each row, by the Jaccard similarity of all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    group = list(range(len(rows)))
    for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2):
        if group[i] != group[j] and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
            group = [group[i] if g == group[j] else g for g in group]
    return group


def brute(rows):
    """Ids that stay."""
    group = groups(rows)
    return {min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}


def corpus(n=150, seed=3):
    """Copies of a few texts with 0 to 16 of 200 words changed: similarities on both sides of 0.8, and chains of them."""
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(10**6)}" for _ in range(200)] for _ in range(9)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 2, 4, 5, 6, 8, 16))):
            words[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, rnd.choice((" ", "\n")).join(words).upper() if i % 7 else " ".join(words)))
    return rows + [(900, None), (901, ""), (902, "one"), (903, "ONE "), (904, "a b c d"), (905, "a b c e"), (906, "word " * 30_000)]


def test_stage_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()} == brute(rows)


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in near_copies.drop_near_copies(docs).collect()} == brute(rows)


def test_nothing(spark):
    assert near_copies.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_decide(spark):
    """Of each group one row stays, whatever the ids: null ids last, equal rows once, and rows that share an id with a copy."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, "a"), (None, text, "a"), (3, text + " x", "b"), (2, "something else entirely stands here", "c"), (2, text, "d"), (2, text, "d"), (None, "and this has no id", None), (None, "and this has no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(tuple, near_copies.drop_near_copies(docs).collect()), key=str)
    assert [r[:2] for r in got] == sorted([(2, "something else entirely stands here"), (2, text), (None, "and this has no id")], key=str)


def test_pivots_find_and_discard(spark):
    """Similar sets share a key and near tables; others share none and are told apart by the table alone."""
    import numpy as np

    pick = np.random.default_rng(5)
    pivots = near_copies._pivots()
    met = far = 0
    for _ in range(60):
        common, rest = pick.integers(0, 2**63, 180, np.uint64), pick.integers(0, 2**63, (4, 20), np.uint64)
        sets = [np.concatenate((common, rest[0])), np.concatenate((common, rest[1])), pick.integers(0, 2**63, 200, np.uint64)]
        keys, table = near_copies.pivot_tables(np.array([near_copies.bit_counts(s) for s in sets]), pivots)
        met += bool(set(keys[0]) & set(keys[1]))
        assert np.abs(table[0].astype(int) - table[1]).max() <= near_copies.LIMIT
        far += np.abs(table[0].astype(int) - table[2]).max() > near_copies.LIMIT
        assert not set(keys[0]) & set(keys[2])
    assert met >= 59 and far >= 55


def test_wide_tables_keep_similar_pairs():
    """Sets of a similarity of exactly 0.8 are never discarded by their wide tables, unrelated ones always."""
    rng, pivots = np.random.default_rng(9), near_copies._pivots()
    pairs = []
    for n in (27, 90, 450):
        for _ in range(60):
            values = rng.integers(0, 1 << 63, n * 10 // 9 + 1, dtype=np.uint64)
            once = n // 9
            pairs += [np.unique(values[:n]), np.unique(values[once : n + once])]
    rows = near_copies.wide_rows([x.tobytes() for x in near_copies.wide_table(np.array([near_copies.bit_counts(s, near_copies.WIDE) for s in pairs]), pivots)])
    sims = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(pairs[::2], pairs[1::2])]
    assert min(sims) > 0.79 and max(sims) < 0.81
    assert ((rows[::2] * rows[1::2]).sum(axis=1) >= near_copies.LEAST_COSINE).all()
    assert ((rows[::2] * np.roll(rows[1::2], 1, axis=0)).sum(axis=1) < near_copies.LEAST_COSINE / 2).all()


def test_sweep_leaves_out_what_is_settled(spark, monkeypatch):
    """Copies of a text that each have changes of their own share keys, but no pair of them is similar; links stay those of all pairs."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in range(6):
            words[33 * j + 5 + rnd.randrange(20)] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
        if i % 5 == 0:
            rows.append((100 + i, " ".join(words[:190])))
    swept, seen = near_copies.swept, []
    monkeypatch.setattr(near_copies, "swept", lambda placed, wide: seen.append(placed.select("node").distinct().count()) or swept(placed, wide))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.drop_near_copies(docs).collect()} == brute(rows) == set(range(60))
    assert seen[0] <= 24  # those with a similar text, which share their changes


def test_unlike_sets_have_no_similar_pair(spark):
    """Sets that are left out are similar to none, also where sizes differ."""
    rnd = random.Random(4)
    sets = [frozenset([*rnd.sample(range(120), rnd.randrange(60, 121)), *range(1000 * i, 1000 * i + rnd.randrange(0, 40))]) for i in range(1, 60)]
    sets += [s - set(rnd.sample(sorted(s), rnd.randrange(1, len(s) // 5))) for s in sets[:20]]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, shingles array<bigint>")
    fewest = min(map(len, sets))
    placed = spark.createDataFrame([(1, i, i, len(s), fewest) for i, s in enumerate(sets)], "key long, node long, part long, n long, fewest long")
    out = {r.node for r in near_copies.unlike_all(placed, rows).collect()}
    similar = {i for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and 5 * len(x & y) >= 4 * len(x | y)}
    assert out and len(similar) >= 20 and not out & similar


def test_keys_of_two_that_were_compared(spark):
    """A key of two nodes is done if its pair was compared; larger keys and pairs beyond the hubs are not."""
    rows = [(1, 1, 1, 9, True), (1, 2, 2, 8, True), (2, 1, 1, 9, True), (2, 3, 3, 7, False), *((3, i, i, 9, True) for i in (1, 2, 3)), (4, 1, 1, 9, False), (4, 2, 1, 9, False)]
    placed = spark.createDataFrame(rows, "key long, node long, part long, n long, compared boolean")
    assert {(r.key, r.fewest) for r in near_copies.parted(placed).collect()} == {(2, 7), (3, 9)}
