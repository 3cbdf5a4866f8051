from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup as E

LONG = "".join(random.Random(3).choices("abcdé fgh ijk\n", k=60_000))
ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, LONG), (6, LONG), (7, LONG + "x"), (8, "a b "), (None, "a b"), (None, "only null"), (9, "twice"), (9, "twice"), (10, "é" * 9000)]


def brute(rows):
    groups, out, done = {}, [], set()
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    for doc, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc, keep, len(ids), doc == keep and (text, doc) not in done, hashlib.sha256((text or "").encode()).hexdigest()))
        done.add((text, doc))
    return sorted(out, key=str)


def few_hashes(chunk):
    return F.pmod(F.xxhash64(chunk), F.lit(3))


@pytest.mark.parametrize("hash_of", [E.chunk_hash, few_hashes])
def test_groups(spark, hash_of):
    docs = spark.createDataFrame([(a, b, "s", 1) for a, b in ROWS], "doc_id long, text string, recipe string, h int")
    got = E.exact_groups(docs, hash_of=hash_of, min_chars=64, max_chars=512).drop("n_chunks").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)


def test_chunks_join_to_the_text(spark):
    docs = spark.createDataFrame([(t,) for _, t in ROWS if t is not None], "text string")
    cut = docs.select("text", E.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r.c) == r.text for r in cut)
    assert max(len(r.c) for r in cut) > 20


def test_empty_and_drop(spark):
    docs = spark.createDataFrame(ROWS[:2] + ROWS[7:8], "doc_id long, text string")
    assert E.exact_groups(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in E.drop_exact_copies(docs).collect()) == [2, 8]


def test_rows_decide(spark):
    """Of each text one row stays, that with the largest id; ids may be null or repeat; equal rows count once."""
    rows = [(1, "a b", "x"), (4, "a b", "y"), (4, "a b", "y"), (4, "other", "z"), (None, "a b", "n"), (None, "alone", None), (None, None, "p"), (2, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, recipe string")
    got = sorted(map(tuple, E.drop_exact_copies(docs).collect()), key=str)
    assert got == sorted([(4, "a b", "y"), (4, "other", "z"), (None, "alone", None), (2, "", "q")], key=str)
