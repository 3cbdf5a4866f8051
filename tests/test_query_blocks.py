"""Blocks of queries: as few as leave each partition a cell, the same matches whatever their size."""

from __future__ import annotations

import re

import numpy as np

from tidewell.operators import products


def test_rows_are_sent_out_as_few_times_as_may_be(spark):
    rng = np.random.default_rng(8)
    vectors = rng.integers(1, 4, (90, 6)).astype(float)
    rows = products.dense_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "row long, x array<double>"), "row", "x")
    queries = rows.filter("row % 2 = 0").withColumnRenamed("row", "query")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    want = {(q, r): float(score[q, r]) for q in range(0, 90, 2) for r in sorted((r for r in range(90) if r != q), key=lambda r: (-score[q, r], r))[:4]}
    for sizes in ({"query_rows": 2, "block_rows": 9}, {"query_rows": 7, "block_rows": 90}, {"query_rows": 4, "block_rows": 30, "most_queries": 5}, {}):
        got = products.best_matches(queries, rows, 4, **sizes)
        assert {(r["query"], r["row"]): r["score"] for r in got.collect()} == want
        blocks = {2: 1, 7: 4, 4: 9}.get(sizes.get("query_rows"), 1)  # of 45 queries; 4 partitions, one cell each at least
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert {int(n) for n in re.findall(r"pmod\(xxhash64\(query#\d+L?, 42\), (\d+)", plan)} == {blocks}
