"""The registered queries themselves, over the smallest tables and odd rows, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_pii_warc_toxicity
from pyspark.sql import functions as F

from tidewell.llm import pii, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = "please call +49 30 5550 1{:03d} or mail to a{}@b.example.com today, card 4111 1111 1111 1111, ip 10.0.0.1"
    odd = [(9000 + i, text.format(i, i), "en", "s", 1) for i in range(9)] + [(9050, "please call 030-555-0199 at once", "en", "s", 1), (9100, None, None, None, None), (9101, "", "en", None, 0), (None, "mail to a@b.co", "en", "s", 1), (9000, text.format(0, 0), "en", "s", 1)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_op2(spark, folder):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = [(i, t, test_pii_warc_toxicity.brute(t)) for i, t in rows]
    others = [[(s, 4, e) for s, e in pii.candidates(t, base)] for _, t, base in found]
    graph, seed = defaultdict(set), defaultdict(bool)
    for (_, t, base), more in zip(found, others):
        for s, k, e in base + more:
            seed[t[s:e]] |= k != 4 and bool(pii._context(t, s, e))
            for p in pii._context(t, s, e):
                graph[p].add(t[s:e])
    # a seed counts as one at the links that it has as a seed
    seeds = {(p, t[s:e]) for _, t, base in found for s, _, e in base for p in pii._context(t, s, e)}
    seed = {x: any((p, x) in seeds for p in graph if x in graph[p]) for x in {x for xs in graph.values() for x in xs}}
    x = {i: 1.0 if s else 0.0 for i, s in seed.items()}
    for _ in range(pii.ROUNDS):
        score = {p: sum(x[i] for i in xs) / (len(xs) + pii.PRIOR) for p, xs in graph.items() if len(xs) >= pii.LEAST_INSTANCES}
        doubt = defaultdict(float)
        for p, xs in graph.items():
            for i in xs:
                doubt[i] += math.log1p(-min(score[p], 0.999)) if p in score else 0.0
        x = {i: 1.0 if s else 1 - math.exp(doubt[i]) for i, s in seed.items()}
    good = {p for p, s in score.items() if s >= pii.LEAST_SCORE}
    join = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    want = []
    for (i, t, base), more in zip(found, others):
        added = [m for m in more if good & set(pii._context(t, m[0], m[2]))]
        counts = [sum(k == n for _, k, _ in base) for n in range(4)]
        want.append((i, *counts, hashlib.sha256(join(base).encode()).hexdigest(), join(base + added)))
    got = pii.op2_pii(spark, folder).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any("other" in r.spans for r in got)


def test_op10(spark, folder):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sharding.op10_sharding(spark, folder).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in rows)
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(16)) and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in by.items())
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sorted(map(str, sharding.op10_sharding(spark, folder).collect())) == sorted(map(str, got))


def test_op7(spark, folder):
    """Each row's chances from the fitted chain, one text at a time: earlier chances feed later models."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    words, chain = toxicity.fit_chain(docs, labels)
    want = []
    for r in docs.collect():
        mine, before = toxicity.features(r.text), []
        for beta in chain:
            z = sum(beta[i] for i, w in enumerate(words) if w in mine) + sum(b * p for b, p in zip(beta[len(words) : -1], before)) + beta[-1]
            before.append(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))))
        want.append((r.doc_id, *[round(p, 9) for p in before], before[-1] >= toxicity.THRESHOLD))
    got = toxicity.op7_toxicity(spark, folder).collect()
    assert sorted(((r.doc_id, round(r.p_quality, 9), round(r.p_toxic, 9), r.toxic) for r in got), key=str) == sorted(want, key=str)


def test_op7_features_know_nothing_of_the_fold(spark):
    """A word that tells toxic rows of one fold only apart is no feature of the models that leave this fold out."""
    rows = [(int(i % 2), f, ["common"] + (["only"] if f == 0 and i % 2 else []) + (["all"] if i % 2 else [])) for f in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "toxic int, fold int, words array<string>")
    found = toxicity._vocabularies(df, ["toxic"])
    assert "only" in found[-1] and "only" in found[1] and "only" not in found[0] and all("all" in v for v in found.values())


def test_op5_pivots_find_the_pairs(spark):
    """All pairs within the radius share a key of the pivot table, others hardly ever; without the table there are no candidates."""
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(400)]
    near = [b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in {*base, *near}], "fp long")
    table = simhash.pivot_table(fps, 2, simhash.N_PIVOTS)
    keys = defaultdict(set)
    for r in simhash.candidate_keys(table, 2).collect():
        keys[r.fp].add((r.which, r.key))
    assert all(keys[signed(a)] & keys[signed(b)] for a, b in zip(base, near))
    met = sum(bool(keys[signed(base[i])] & keys[signed(base[j])]) for i in range(400) for j in range(i))
    assert met < 5
    whole = {r.fp: np.array(r.table, int) for r in table.collect()}
    assert all(np.abs(whole[signed(a)] - whole[signed(b)]).max() <= 2 for a, b in zip(base, near))
    discarded = sum(np.abs(whole[signed(base[i])] - whole[signed(base[j])]).max() > 2 for i in range(400) for j in range(i))
    assert discarded > 0.999 * 400 * 399 / 2
    blank = table.withColumn("parts", F.transform("parts", lambda x: F.lit(0).cast("long")))
    assert simhash.candidate_keys(blank, 2).select("which", "key").distinct().count() == 6
