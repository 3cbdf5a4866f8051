"""The stages in turn over the smallest tables and odd rows, each against brute force on its own input."""

from __future__ import annotations

import re
from collections import Counter

import test_decontamination
import test_mixing_sharding
import test_near_copies

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    text, items = first.text, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = "of the there and with one so that it was here before all of them had gone home again"
    odd = [(5000, None, "en", "src0", 0), (5001, "", "en", None, 0), (5002, "12 % 34", None, "src1", 7), (5003, "Привет, как дела сегодня", "en", "src1", 7)]
    # copies with null ids, with other columns only, and clean rows that share an id with a copy or a leak
    odd += [(None, text, None, None, None), (None, text, None, None, None), (5005, text.upper(), "en", "src2", 1), (first.doc_id, text, "en", "elsewhere", 3)]
    odd += [(first.doc_id, clean + " one", "en", "src0", 5), (5006, items[0][1], "en", "src0", 5), (5006, clean + " two or three other words to end with", "en", "src0", 5), (None, items[1][1], "en", "src1", 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "source_mixing", "final_sharding"]

    def step(name, before):
        out = stages[name](spark, before, SF).cache()
        assert out.columns[: len(columns)] == columns
        return out, [tuple(r) for r in out.collect()]

    kept, rows = step("language_id", docs)
    assert Counter(rows) == Counter(r for r in map(tuple, docs.collect()) if any(c.isalpha() for c in r[1] or "") and r[0] != 5003)

    unique, after = step("near_dedup", kept)
    assert not Counter(after) - Counter(rows)
    groups = test_near_copies.groups([r[:2] for r in rows])
    stay = {g: min((rows[i] for i in range(len(rows)) if groups[i] == g), key=lambda r: (r[0] is None, r[0] or 0)) for g in set(groups)}
    assert Counter((r[0], r[1]) for r in after) == Counter((r[0], r[1]) for r in stay.values())

    clean, rows = step("benchmark_decontamination", unique)
    leaks = {t for _, t in {(i, r[1]) for i, r in enumerate(after)} if test_decontamination.brute([(0, t)], items)}
    assert leaks and Counter(rows) == Counter(r for r in after if r[1] not in leaks)

    mixed, after = step("source_mixing", clean)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
        longest[r[3]] = max(longest[r[3]], size(r[1]))
    for r in after:
        taken[r[3]] += size(r[1])
    for source, target in test_mixing_sharding.targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= longest[source] + 1024 * len(sizes)
    assert max(Counter(after).values()) <= 3 * max(Counter(rows).values()) and set(after) <= set(rows)

    sharded, last = step("final_sharding", mixed)
    assert Counter(r[: len(columns)] for r in last) == Counter(after) and sharded.columns == [*columns, "shard", "slot"]
    by = Counter(r.shard for r in sharded.collect())
    assert max(by.values()) - min(by.values()) <= 1 and len(by) == 16
    assert corpus_pipeline.ORACLE_SQL is None


def test_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
