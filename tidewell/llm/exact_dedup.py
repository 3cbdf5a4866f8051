"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut into chunks at places that its own characters choose, so equal
passages give equal chunks wherever they stand. Every distinct chunk gets an
identifier, which is verified against the chunk's characters: texts move between
tasks once, as chunks that each task has already deduplicated. A document is then
its recipe, the ordered list of its chunks' identifiers, and documents are
compared by recipe alone.

Defined cases: a null text counts as empty; the empty text has the empty recipe;
of rows equal in text and doc_id one stays; a null doc_id is smaller than any
other; an empty table gives an empty result; other columns are ignored, and kept by
``drop_exact_copies``, which tells rows of an id apart by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.rows import KEY, keep, row_key
from tidewell.storage import stored

#: Characters of a chunk: no anchor is looked for before the first number, and none after the second.
MIN_CHARS, MAX_CHARS = 1024, 8192
#: An anchor is a place between white space and one of these.
ANCHOR = r"(?<=[\s])(?=[^\x00-\x60e-z{-\x7f\x80-\xbf]|[A-D])"


def chunks(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """The text as an array of chunks; joined without separator they give the text again."""
    pattern = rf"(?s).{{{min_chars},{max_chars - 1}}}?{ANCHOR}|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def clashes(texts: DataFrame, hash_of=chunk_hash, **sizes) -> DataFrame:
    """(h): hashes that different chunks share. Distinct chunks are compared by their characters."""
    # outer: of other generators the optimizer infers a filter that cuts the text twice
    each = texts.select(F.explode_outer(chunks(F.col("text"), **sizes)).alias("chunk")).filter("chunk IS NOT NULL")
    distinct = each.select(hash_of(F.col("chunk")).alias("h"), "chunk").distinct()
    return distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def variants(texts: DataFrame, clashing: DataFrame, hash_of=chunk_hash, **sizes) -> DataFrame:
    """(text_sha256, variant): for texts with clashing chunks, which chunk of its hash each of them is, in order."""
    parts = (
        texts.select(F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"), **sizes)).alias("pos", "chunk"))
        .withColumn("h", hash_of(F.col("chunk")))
        .join(clashing, "h", "left_semi")
    )
    named = parts.select("h", "chunk").distinct()
    others = named.select(F.col("h").alias("h2"), F.col("chunk").alias("chunk2"))
    ranked = named.join(others, (F.col("h") == F.col("h2")) & (F.col("chunk2") <= F.col("chunk"))).groupBy("h", "chunk").agg(F.count("*").alias("rank"))
    found = parts.dropDuplicates(["text_sha256", "pos"]).join(ranked, ["h", "chunk"])
    return found.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("variant"))


def recipes_of(docs: DataFrame, id_col: str, text_col: str, hash_of, named: bool = False, **sizes) -> tuple[DataFrame, list[str]]:
    """(doc_id, text_sha256, recipe) per row, with ``named`` also _row_key, and the columns that are equal for equal texts only."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([row_key(docs).alias(KEY)] if named else []))
    others = [KEY] if named else []
    recipes = stored(texts.select("doc_id", *others, F.sha2("text", 256).alias("text_sha256"), F.transform(chunks(F.col("text"), **sizes), hash_of).alias("recipe")), "recipes")
    clashing = stored(clashes(texts, hash_of, **sizes), "clashes")
    if clashing.isEmpty():
        return recipes, ["recipe"]
    recipes = recipes.join(variants(texts, clashing, hash_of, **sizes), "text_sha256", "left").withColumn("variant", F.coalesce("variant", F.array()))
    return recipes, ["recipe", "variant"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=chunk_hash, **sizes) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    recipes, key = recipes_of(docs, id_col, text_col, hash_of, **sizes)
    rows = recipes.groupBy("doc_id", "text_sha256", *key).agg(F.count("*").alias("copies"))
    groups = stored(recipes.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    each = rows.join(groups, key).select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text: that with the largest id, null last; of rows equal in every column any one."""
    recipes, key = recipes_of(docs, id_col, text_col, chunk_hash, named=True)
    return keep(docs, recipes.select(KEY, "doc_id", F.struct(*key).alias("component_id")), largest=True)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_chunks")


ORACLE_SQL = """
SELECT doc_id, keep_id, group_size, text_sha256,
       doc_id IS NOT DISTINCT FROM keep_id AND nth = 1 AS kept
FROM (SELECT doc_id, sha256(t) AS text_sha256,
             max(doc_id) OVER (PARTITION BY t) AS keep_id,
             count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t, doc_id) AS nth
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""
