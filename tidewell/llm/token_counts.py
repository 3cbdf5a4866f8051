"""Exact length histogram of encoded documents.

Each whole text is encoded where it lies and only its length goes on: documents are
counted per length, and suffix sums over the histogram answer how many documents and
tokens there are, how many a context limit would cut off, how many tokens would stay,
and at which length each share of the documents or tokens is reached. The histogram has
a row per distinct length, however many documents there are; its running sums are made
in ranges of lengths, so the longest histogram isn't one task's either.

Defined cases: null and empty texts have no tokens and count as length 0; strings of
special tokens are ordinary text; repeated rows count each; an empty table gives an
empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.storage import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's text is cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths in a range of the running sums.
RANGE = 1024

_ENCODERS: dict = {}


def encoder(path: str):
    import tiktoken

    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens) per row. ``vocabulary`` is a rank file that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t.as_py() or "")) for t in batch.column(0)], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs.

    n_docs, n_tokens: with this length. docs_from, tokens_from: with this length or more.
    kept_tokens: what is left of all tokens if each document is cut to this length;
    cut_docs: how many are cut. doc_share, token_share: of those up to this length.
    """
    counts = stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    down = W.orderBy(F.col("range").desc())
    ranges = counts.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    total = W.partitionBy(F.lit(0))
    ranges = ranges.select(
        "range",
        (F.sum("d").over(down) - F.col("d")).alias("docs_above"),
        (F.sum("t").over(down) - F.col("t")).alias("tokens_above"),
        F.sum("d").over(total).alias("all_docs"),
        F.sum("t").over(total).alias("all_tokens"),
    )
    within = W.partitionBy("range").orderBy(F.col("n_tokens").desc())
    rows = counts.withColumn("d", F.sum("n_docs").over(within)).withColumn("t", F.sum("tokens").over(within)).join(ranges, "range")
    docs_from, tokens_from = F.col("docs_above") + F.col("d"), F.col("tokens_above") + F.col("t")
    cut = docs_from - F.col("n_docs")
    return rows.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        cut.alias("cut_docs"),
        (F.col("all_tokens") - tokens_from + F.col("tokens") + cut * F.col("n_tokens")).alias("kept_tokens"),
        ((F.col("all_docs") - cut) / F.col("all_docs")).alias("doc_share"),
        F.when(F.col("all_tokens") > 0, (F.col("all_tokens") - tokens_from + F.col("tokens")) / F.col("all_tokens")).otherwise(1.0).alias("token_share"),
    )


def kept_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, kept_tokens, cut_docs) for any limits, those between two lengths included."""
    kept = [F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs")) for x in limits]
    cut = [F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs"))) for x in limits]
    each = [F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(k, F.lit(0)).alias("kept_tokens"), F.coalesce(c, F.lit(0)).alias("cut_docs")) for x, k, c in zip(limits, kept, cut, strict=True)]
    return histogram.agg(F.array(*each).alias("each")).select(F.inline("each"))


def length_at(histogram: DataFrame, share: float) -> DataFrame:
    """(n_tokens): the smallest length that this share of the documents doesn't exceed."""
    return histogram.filter(F.col("doc_share") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
