from __future__ import annotations

import itertools
import random
import re

import pytest
import xxhash

from tidewell.llm import simhash


def brute(rows, shingle=3, radius=2):
    fps = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0)
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius and group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted(((rows[i][0], f"{fps[i]:016x}", least[group[i]]) for i in range(len(rows))), key=str)


def corpus(n=160, seed=1):
    rnd = random.Random(seed)
    words = ["ab", "Cd", "éf", "gh", "ij", "kl", "mn", "op"]
    base = [[rnd.choice(words) + str(rnd.randrange(9)) for _ in range(300)] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = "x" + str(rnd.randrange(99))
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "a b c d"), (None, "one"), (7, rows[3][1]), (7, rows[3][1]), (907, "word " * 30_000)]


@pytest.mark.parametrize("cap", [2048, 3])
def test_groups_equal_brute_force(spark, cap):
    rows = corpus()
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_groups(docs, max_key_rows=cap).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_other_radius(spark):
    rows = corpus(60, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for radius, cap in ((1, 2048), (3, 2048), (3, 4)):
        got = simhash.near_groups(docs, radius=radius, max_key_rows=cap).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, radius=radius)


def test_empty(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_drop_near_copies(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b  c D"), (3, "other words here now")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [1, 3]
