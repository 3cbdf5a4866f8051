from __future__ import annotations

import pytest

import zlib

from tidewell.llm import langid, token_counts


def test_histogram_equals_brute_force(spark):
    texts = [None, "", "a", "a b c", "word " * 50, "<|endoftext|>", "é" * 70_000, "a", "x" * 200_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_docs int")
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    lengths = [len(encode(t or "")) for t in texts]
    histogram = token_counts.length_histogram(token_counts.token_lengths(docs)).cache()
    for r in histogram.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_from == sum(x >= r.n_tokens for x in lengths) and r.cut_docs == sum(x > r.n_tokens for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.n_tokens)
        assert r.kept_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert r.doc_share == sum(x <= r.n_tokens for x in lengths) / len(lengths)
    for r in token_counts.kept_at(histogram, [0, 2, 57, 10**7]).collect():
        assert r.kept_tokens == sum(min(x, r.context_limit) for x in lengths) and r.cut_docs == sum(x > r.context_limit for x in lengths)
    assert token_counts.length_at(histogram, 0.5).first()[0] == sorted(lengths)[4]
    assert token_counts.length_histogram(token_counts.token_lengths(docs.limit(0))).count() == 0


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, "s", 0), (10**6 + 2, "12 34 !?", "en", "s", 0), (None, "les deux et la", None, None, None)], docs.schema)
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(odd)).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (10**6, 10**6 + 1, 10**6 + 2))
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out
    kept = langid.keep_identified(docs.unionByName(odd))
    assert kept.columns == docs.columns and kept.count() == docs.count() + 1


def test_filter_uses_the_prediction(spark):
    """Of other scripts nothing stays, of learned languages all; wanted languages and scores are parameters; rows decide, not ids."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = ["Привет, как дела сегодня? Мы идем в большой магазин", "καλημέρα κόσμε, πώς είσαι σήμερα;", "日本語のテキストです", "12 34"]
    odd = spark.createDataFrame([(1, t, "en", "s", 0) for t in other] + [(None, "les deux et la", None, None, None)], docs.schema)
    kept = langid.keep_identified(docs.unionByName(odd))
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.unionByName(odd.filter("doc_id IS NULL")).collect()))
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    some = langid.keep_identified(docs, languages=["de", "xx"], least_score=0.9)
    assert sorted(r.doc_id for r in some.collect()) == sorted(i for i, r in found.items() if r.lang_pred == "de" and r.score >= 0.9)


def test_op4_equals_brute_force(spark, tmp_path):
    """The query's own rows against the machines run one text at a time, and against a plain vote over all languages."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in langid.op4_langid(spark, str(tmp_path)).collect()}
    langs, machines, _ = langid.fit(docs)
    for r in docs.collect():
        x = langid.features(r.text)
        if x is None:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        dense = [0.0] * langid.DIMS
        for i, v in zip(*x):
            dense[i] = v
        margin = {n: sum(a * b for a, b in zip(w, dense)) + w[-1] for n, w in machines.items()}
        families = {langid.family(x) for x in langs}
        best = max(sorted(families), key=lambda f: margin[f])
        inside = [x for x in langs if langid.family(x) == best]
        wins = {x: sum((margin[n] >= 0) == (n.split()[0] == x) for n in machines if x in n.split()) for x in inside}
        assert wins[got[r.doc_id].lang_pred] == max(wins.values())
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(docs).collect()} == {("und", 0.0)}
    assert [r.doc_id for r in langid.keep_identified(docs).collect()] == [1]
    assert langid.identify(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "some text", "en"), (4, "other", "en"), (5, "word", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(one).collect()} == {"en"}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "andere", None), (3, "12", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.keep_identified(docs).orderBy("doc_id").collect()] == [1, 2]
    for asked in ({"languages": ["de"]}, {"least_score": 0.5}):
        with pytest.raises(ValueError):
            langid.keep_identified(docs, **asked)
        assert langid.keep_identified(docs.limit(0), **asked).count() == 0
