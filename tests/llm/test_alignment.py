"""Alignment of tokenizers against plain Python with the other encoder."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewell.llm import alignment as al

SCHEMA = "doc_id long, text string, n_a int"


@pytest.fixture(scope="module")
def sides():
    t = Tokenizer.from_file(al.BYTE_BPE)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=al.PIECE_BPE)


def brute(rows, t, sp):
    """The contract's columns, link by link."""
    letters = al._byte_letters()
    docs = []
    for i, text in rows:
        groups, links, n = [], [], (0, 0)
        if text:
            want = b" " + text.encode()
            a = [(x, bytes(letters[c] for c in t.id_to_token(x))) for x in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(x, bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode()) for x in sp.encode(text) for p in [sp.id_to_piece(x)]]
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                spans = [[], []]
                for side, tokens in zip(spans, (a, b)):
                    at = 0
                    for x, piece in tokens:
                        side.append((x, at, at + len(piece)))
                        at += len(piece)
                links = [(x, y) for x, s, e in spans[0] for y, s2, e2 in spans[1] if s < e2 and s2 < e]
                both = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
                low = 0
                for high in both:
                    groups.append("|".join(",".join(str(x) for x, s, e in side if low < e <= high) for side in spans))
                    low = high
                n = len(a), len(b)
        docs.append((i, *n, groups, links))
    held = Counter(p for *_, links in docs for p in set(links))
    top = defaultdict(int)
    for (x, _), c in held.items():
        top[x] = max(top[x], c)
    out = []
    for i, n_a, n_b, groups, links in docs:
        text = ";".join(groups)
        out.append((i, n_a, n_b, len(groups), len(links), hashlib.sha256(text.encode()).hexdigest() if text else "", sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links)))
    return sorted(out, key=str), held


def rows_of(n):
    rnd = random.Random(n)
    words = ["the", "tokenization", "Straße", "日本語", "naïve", "\U0001f600", "  ", "x1y2", "don't", "<|endoftext|>", "</s>", "<0x41>", "▁", "\t", "\n", "12345", "é", "ﬁ", "…", "ünder"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 25)))) for i in range(n)]
    return rows + [(1, rows[1][1]), (1, "again"), (None, "no id"), (900, None), (901, ""), (902, " "), (903, "two  spaces"), (904, "a\x00b"), (905, " lead"), (906, "trail ")]


@pytest.mark.parametrize("entries", [al.BLOCK_ENTRIES, 60])
def test_against_links(spark, sides, entries):
    rows = rows_of(120)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    found = al.blocks(df, block_entries=entries)
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    best = F.col("docs") == F.max("docs").over(W.partitionBy("a"))
    got = al.scored(found, [best.cast("int"), F.col("docs")], ["n_best", "count_sum"]).collect()
    want, held = brute(rows, *sides)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == want
    counts = {(r.a, r.b): (r.docs, r.links) for r in al.pair_counts(found).collect()}
    assert {p: c for p, (c, _) in counts.items()} == held
    assert sum(n for _, n in counts.values()) == sum(r[4] for r in want)


def test_query(spark, sides, tmp_path):
    """The query over the smallest table's documents, and one of 20,000 words, equals plain Python over the same rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "n_chars").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 6000]
    spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = al.op13_token_alignment(spark, str(tmp_path)).collect()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == brute(rows, *sides)[0]
    assert sum(r.n_links for r in got) > 10_000


def test_long_and_empty(spark, tmp_path):
    rows = [(1, "word " * 20_000 + "end"), (2, "x" * 100_000), (3, "word word"), (4, " " * 100_000 + "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = {r.doc_id: r for r in al.scored(al.blocks(df), [al.F.col("docs"), al.F.col("links")], ["docs", "links"]).collect()}
    assert got[1].n_a == 20_001 and got[1].links > 19_000**2 and got[3].docs == 4 and got[2].n_links > 0
    assert al.scored(al.blocks(df.limit(0)), [al.F.col("docs")], ["docs"]).count() == 0


def test_same_ids_as_the_other_encoder(sides):
    """The json vocabulary gives the same ids in both libraries that read it."""
    side = al.byte_side(al.BYTE_BPE)
    texts = [t for _, t in rows_of(300) if t]
    assert side.encode(texts) == [sides[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_bitmaps_round_trip():
    rnd = np.random.default_rng(5)
    for n_docs, n in ((1, 1), (7, 30), (300, 4000), (65_536, 5000)):
        entries = np.unique((rnd.integers(0, 40, n) << 16) | rnd.integers(0, n_docs, n))
        times = rnd.integers(1, 20, len(entries))
        maps = al.inverted(rnd.permutation(entries), times, n_docs)
        values = np.stack([maps["docs"], np.ones_like(maps["docs"])], axis=1)
        total = al.handed_out(maps["planes"], values, n_docs)
        assert total[:, 1].sum() == times.sum() == maps["links"].sum() and maps["docs"].sum() == len(entries)
        dense, rest = al.packed(np.repeat([0, 1], [n_docs, 1]), np.concatenate([np.arange(n_docs), [0]]), np.array([n_docs, 1]), n_docs)
        index, doc = al.unpacked(np.array([n_docs, 1]), n_docs, dense, rest)
        assert sorted(zip(index.tolist(), doc.tolist())) == [(0, d) for d in range(n_docs)] + [(1, 0)]
