from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.llm import mixing, sharding

rnd = random.Random(5)
ROWS = [(i, " ".join("w" for _ in range(rnd.randrange(1, 60))), rnd.choice(["hot"] * 9 + ["b", "c", "d", None])) for i in range(300)]
ROWS += [(500, None, "b"), (501, "", None), (None, "x y", "c"), (7, ROWS[7][1], ROWS[7][2]), (502, "w " * 4000, "d"), (503, None, "empty source")]
SCHEMA = "doc_id long, text string, source string"


def targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def brute(rows, want, packet=1024):
    """(doc_id, source, size, words taken) of each document and epoch: the sequence of packets by finish time up to the budget."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(range(len(rows)), key=lambda i: (md5(f"mix|{'null' if rows[i][0] is None else rows[i][0]}|{md5(rows[i][1] or '')}"), rows[i][0] or -1))
    through, packets, budget = Counter(), [], sum(size(r[1]) for r in rows)
    total = Counter()
    for r in rows:
        total[r[2]] += size(r[1])
    for nth, i in enumerate(order):
        n, source = size(rows[i][1]), rows[i][2]
        for epoch in range(3):
            for begin in range(0, n, packet):
                words = min(packet, n - begin)
                packets.append(((epoch * total[source] + through[source] + begin + words) / want[source], source is None, source or "", epoch, nth, begin, words, i))
        through[source] += n
    taken = Counter()
    for *_, epoch, _, _, words, i in sorted(packets):
        got = min(words, budget)
        budget -= got
        if got:
            taken[i, epoch] += got
    served = {i for i, _ in taken}
    return Counter((rows[i][0], rows[i][2], size(rows[i][1]), n) for (i, _), n in taken.items()) + Counter((r[0], r[2], size(r[1]), 0) for i, r in enumerate(rows) if i not in served)


def test_mix(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, source in ROWS:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = targets(dict(sizes)), Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= r.size
    assert sum(taken.values()) == sum(sizes.values())
    for s, t in want.items():
        assert abs(t - taken[s]) <= sum(min(sizes[x], mixing.PACKET) for x in sizes)
    assert Counter((r.doc_id, r.source, r["size"], r.taken) for r in rows) == brute(ROWS, want)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixed_rows_and_empty(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counts = Counter(r.doc_id for r in out.collect())
    assert max(counts.values()) <= 6 and 500 not in counts
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.filter("text IS NULL")).agg(F.sum("taken")).first()[0] == 0


def whole(docs):
    return Counter(tuple(r)[: len(SCHEMA.split(",")) + 1] for r in docs.collect())


ALIKE = [(1, None, "a", 1), (1, "", "b", 2), (1, "", None, 2), (2, "t", "c", 3), (2, "t", "d", 3), (None, "t", "d", 3), (2, "t", "d", 3), (3, "null", "e", None)]


def test_rows_that_differ_in_other_columns_only(spark):
    docs = spark.createDataFrame(ALIKE, "doc_id long, text string, source string, _x int").repartition(3)
    out = sharding.shard_rows(docs, 2, carry=True)
    assert Counter(tuple(r)[:4] for r in out.collect()) == Counter(ALIKE)
    assert sorted((r.shard, r.slot) for r in out.collect()) == [(s, i) for s in range(2) for i in range(4)]
    copies = Counter(tuple(r) for r in mixing.mixed(docs).collect())
    assert set(copies) <= {r for r in ALIKE if r[1]}
    assert sum(copies.values()) == 5 and {r for r in ALIKE if r[2] == "d"} <= set(copies)


def test_lines_and_levels(spark):
    """One partition in many lines, so that the matrix is drawn on several levels."""
    docs = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_rows(docs, 7, line_bits=1).collect()
    assert len({r.doc_id for r in rows}) == 3000
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    near = sum(a.shard == b.shard for a, b in zip(sorted(rows, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r.doc_id)[1:]))
    assert abs(near - 2999 / 7) < 5 * (2999 / 7) ** 0.5
    assert sorted(map(tuple, sharding.shard_rows(docs, 7, line_bits=1).collect())) == sorted(map(tuple, rows))


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    sharding.write_shards(docs, str(tmp_path / "out"), file_rows=5, n_shards=4)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in ROWS)
    assert len(list((tmp_path / "out").glob("shard=0/*.parquet"))) >= len(ROWS) // 4 // 5


def test_shards(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(7)
    rows = sharding.shard_rows(docs).collect()
    assert len(rows) == len(ROWS)
    by = Counter(r.shard for r in rows)
    assert set(by.values()) <= {len(ROWS) // 16, len(ROWS) // 16 + 1}
    for s, n in by.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    carried = sharding.shard_rows(docs, carry=True)
    assert carried.columns == [*docs.columns, "shard", "slot"] and carried.count() == len(ROWS)
    few = sharding.shard_rows(docs.limit(3)).collect()
    assert len({r.shard for r in few}) == 3
    assert sharding.shard_rows(docs.limit(0)).count() == 0


def test_shuffle_is_uniform(spark):
    """Two rows of one partition come to one shard as often as any two."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(2)
    together, n, orders = 0, 6, set()
    for seed in range(n):
        got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(docs, 3, seed=seed).collect()}
        orders.add(tuple(sorted(got, key=got.get)))
        together += sum(got[i][0] == got[j][0] for i in range(30) for j in range(i))
    assert len(orders) == n
    assert abs(together / (n * 435) - 19 / 59) < 0.03


def test_hypergeometric_law(spark):
    draws = spark.range(4000).select(sharding.hypergeometric(F.lit(20), F.lit(7), F.lit(9), sharding._uniform(F.lit(3), F.col("id"))).alias("x"))
    got = {r.x: r["count"] for r in draws.groupBy("x").count().collect()}
    from math import comb

    for x in range(8):
        p = comb(7, x) * comb(13, 9 - x) / comb(20, 9)
        assert abs(got.get(x, 0) - 4000 * p) <= 5 * (4000 * p) ** 0.5 + 3
