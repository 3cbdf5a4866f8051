"""Naming rows, and joining decisions made on narrow rows back to whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType, VariantType

from tidewell.storage import stored

KEY = "_row_key"
#: What a null is in a row's name; no md5, number or JSON object reads so.
NULL = "~"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffle_key(id_col: str, text_col: str, seed: str) -> Column:
    """A pseudo-random order of rows by id and text; rows alike in both come together."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def _part(name: str, kind: DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(kind, StringType):
        return F.coalesce(F.md5(column), F.lit(NULL))
    if isinstance(kind, BinaryType):
        return F.coalesce(F.sha2(column, 256), F.lit(NULL))
    if isinstance(kind, (ArrayType, MapType, StructType, VariantType)):
        return F.coalesce(F.to_json(F.struct(column.alias("x")), {"ignoreNullFields": "false"}), F.lit(NULL))
    return F.coalesce(column.cast("string"), F.lit(NULL))


def row_key(docs: DataFrame) -> Column:
    """A name that two rows of ``docs`` share only if they are equal in every column; null differs from empty."""
    return F.md5(F.concat_ws("|", *[_part(f.name, f.dataType) for f in docs.schema.fields]))


def attach(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The columns of ``docs`` and then those of ``decided``, a row for each row of ``decided``, by its ``_row_key``.

    Only rows that are equal in every column share a key, and any of them can stand for the others; texts move once.
    """
    whole = docs.withColumn(KEY, row_key(docs)).dropDuplicates([KEY])
    theirs = [c for c in decided.columns if c != KEY]
    return whole.join(decided, KEY).select(*[whole[f"`{c}`"] for c in docs.columns], *[decided[c] for c in theirs])


def keep(docs: DataFrame, groups: DataFrame, largest: bool = False) -> DataFrame:
    """One row of ``docs`` for each group: that with the smallest id (or the ``largest``; null last), any one of several equal rows.

    ``groups`` has (_row_key, doc_id, component_id) for each row. Whole rows stay where they are
    and are checked against the keys that go; only rows that repeat in every column move.
    """
    keys = groups.groupBy("component_id", KEY, "doc_id").agg(F.count("*").alias("copies"))
    known = F.col("doc_id").isNotNull()
    first = F.max(F.struct(known.alias("known"), "doc_id", KEY)) if largest else F.min(F.struct((~known).alias("none"), "doc_id", KEY))
    first = keys.groupBy("component_id").agg(first.alias("first"))
    same = keys["component_id"].eqNullSafe(first["component_id"])
    marked = keys.join(first, same).select(keys[KEY], "copies", (F.col(KEY) == F.col(f"first.{KEY}")).alias("stays"))
    marked = stored(marked.filter("copies > 1 OR NOT stays"), "row_decisions")
    named = docs.withColumn(KEY, row_key(docs))
    once = named.join(marked.select(KEY), KEY, "left_anti")
    again = named.join(marked.filter("stays").select(KEY), KEY, "left_semi").dropDuplicates([KEY])
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(again.select(*[F.col(f"`{c}`") for c in docs.columns]))
