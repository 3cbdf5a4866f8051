"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source is a queue of its documents in shuffled order, served at a rate in
proportion to its target. A document's virtual finish time is the words its source
has served up to and with it, divided by the target; a source starts over when it is
through, up to ``max_epochs`` times. All documents are range-sorted by that time over all
sources, and the mix is the sequence up to the total budget, the words of all sources:
what stands at the budget gives the words that are left, and nothing after it is taken.

Documents of over PACKET words are served in packets of that many, each with its own
finish time, so no long document holds up the others: each source's words differ from
its target by little more than a packet of each source.

Running sums are made in two steps, totals of small ranges first and rows within a
range second, so no source and no sort lands in one task. The totals also say which
ranges the budget reaches, and only these are sorted.

Defined cases: a null text has no words; a null source is a source of its own, the
last one; sources without words have target 0; rows without words take nothing; ids may
be null or repeat, and rows equal in id and text are separate rows; an empty table gives
an empty result; other columns are ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.rows import KEY, attach, row_key, shuffle_key
from tidewell.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"
#: Words of a document that are served at once.
PACKET = 1024
#: Rows that a range of a running sum has, about.
RANGE_ROWS = 16_384


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, each at most ``max_epochs`` times its source.

    The excess of sources at their limit goes to the others by weight: all get weight
    times one level, or their limit if that is less. With sources in the order of
    limit by weight, the level is the largest of those that hold if the sources before
    one, and only those, are at their limit. One row per source goes through one task.
    """
    everything = W.partitionBy(F.lit(0))
    by_code = W.orderBy(F.col("source").asc_nulls_last())
    before = W.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_code)).withColumn("weight", weight.cast("long"))
    levels = (
        ranked.withColumn("limit", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    )
    share = F.col("weight") * F.max("level").over(everything)
    return levels.select("source", "source_size", F.least(F.col("limit").cast("double"), share).alias("target"))


def _ranges(rows: int) -> int:
    """A power of two, so that there are about RANGE_ROWS rows in each."""
    return 1 << max(0, (max(rows, 1) // RANGE_ROWS).bit_length())


def _queued(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], max_epochs: int, seed: str, named: bool) -> DataFrame:
    """Each row with its place in its source's queue: ``start`` words are served before it in an epoch."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        shuffle_key(id_col, text_col, seed).alias("key"),
        (row_key(docs) if named else F.lit("")).alias(KEY),
    )
    sized = stored(sized, "sizes")
    targets = stored(source_targets(sized, weights, max_epochs), "targets")
    n = _ranges(sized.count())
    ranged = sized.withColumn("row_range", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * n / F.lit(16**7)))
    offsets = ranged.groupBy("source", "row_range").agg(F.sum("size").alias("words"))
    offsets = offsets.select("source", "row_range", (F.sum("words").over(W.partitionBy("source").orderBy("row_range")) - F.col("words")).alias("offset"))
    in_range = W.partitionBy("source", "row_range").orderBy("key", "doc_id", "size", KEY).rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = ranged.withColumn("row_no", F.count("*").over(in_range)).withColumn("through", F.sum("size").over(in_range))
    same_range = queued["source"].eqNullSafe(offsets["source"]) & (queued["row_range"] == offsets["row_range"])
    queued = queued.join(offsets, same_range).drop(offsets["source"]).drop(offsets["row_range"])
    queued = queued.join(targets, queued["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    return stored(queued.withColumn("start", F.col("offset") + F.col("through") - F.col("size")).drop("key", "offset", "through"), "queued")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, named: bool = False) -> DataFrame:
    """One row per document and epoch that the mix takes words of, and one (epoch null) per document it takes none of.

    Columns: _row_key (with ``named``), row_range, row_no (with source: the document's row),
    doc_id, source, size, source_size, target, epoch (from 0), finish (virtual, of the last
    packet taken), taken, position (words of the mix before it).
    """
    queued = _queued(docs, id_col, text_col, source_col, weights, max_epochs, seed, named)
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    begins = F.when((F.col("size") > 0) & (F.col("target") > 0), F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PACKET).cast("long")))
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))
    packets = queued.withColumn("epoch", epochs).withColumn("begin", F.explode(begins)).withColumn("words", F.least(F.lit(PACKET).cast("long"), F.col("size") - F.col("begin")))
    packets = packets.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("start") + F.col("begin") + F.col("words")) / F.col("target"))
    # in each stretch of virtual time all sources together serve about the same number of words, so these ranges are even
    slices = _ranges(queued.count() + budget // PACKET)
    packets = packets.withColumn("slice", F.floor(F.col("finish") * slices))
    totals = packets.groupBy("slice").agg(F.sum("words").alias("words"))
    reached = totals.select("slice", (F.sum("words").over(W.orderBy("slice")) - F.col("words")).alias("before")).filter(F.col("before") < budget)
    reached = stored(reached, "reached_slices")
    in_slice = W.partitionBy("slice").orderBy("finish", F.col("source").asc_nulls_last(), "epoch", "row_range", "row_no", "begin").rowsBetween(W.unboundedPreceding, W.currentRow)
    sequence = packets.join(reached, "slice").withColumn("upto", F.sum("words").over(in_slice))
    sequence = sequence.withColumn("position", F.col("before") + F.col("upto") - F.col("words")).filter(F.col("position") < budget)
    taken = F.least(F.col("words"), F.lit(budget) - F.col("position"))
    row = [KEY, "row_range", "row_no", "doc_id", "source", "size", "source_size", "target"]
    served = sequence.groupBy(*row, "epoch").agg(F.max("finish").alias("finish"), F.sum(taken).alias("taken"), F.min("position").alias("position"))
    served = stored(served, "served")
    got = served.select("source", "row_range", "row_no").distinct()
    same = queued["source"].eqNullSafe(got["source"]) & (queued["row_range"] == got["row_range"]) & (queued["row_no"] == got["row_no"])
    unserved = queued.join(got, same, "left_anti").select(*row, *[F.lit(None).cast(t).alias(c) for c, t in (("epoch", "int"), ("finish", "double"))], F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("position"))
    return served.unionByName(unserved)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, whole: a document for each epoch that takes half of its words or more."""
    copies = mix(docs, id_col, text_col, source_col, named=True, **options).filter((F.col("size") > 0) & (F.col("taken") * 2 >= F.col("size")))
    return attach(docs, copies.select(KEY))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    copies = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = copies.groupBy("source", "row_range", "row_no", "doc_id", "size", "source_size", "target")
    return each.agg(F.sum("taken").alias("taken"), F.min("position").alias("first_position")).drop("source", "row_range", "row_no")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER p, 0)::BIGINT) / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER p, 0)::BIGINT) AS level
  FROM w WINDOW p AS (ORDER BY (3 * source_size) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * (max(level) OVER ())) AS target FROM l),
q AS (
  SELECT d.*, source_size, target, row_number() OVER o AS nth, (sum(size) OVER o)::BIGINT - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
  WINDOW o AS (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
c AS (
  SELECT *, epoch * source_size + start AS begun, unnest(range(0, size, 1024)) AS first
  FROM q, (VALUES (0), (1), (2)) e(epoch)
  WHERE size > 0 AND target > 0),
m AS (
  SELECT *, least(1024, size - first) AS words, (begun + first + least(1024, size - first)) / target AS finish FROM c),
o AS (
  SELECT *, (sum(words) OVER (ORDER BY finish, source NULLS LAST, epoch, nth, first ROWS UNBOUNDED PRECEDING))::BIGINT - words AS position FROM m),
b AS (
  SELECT coalesce(sum(size), 0)::BIGINT AS budget FROM d),
g AS (
  SELECT source, nth, sum(least(words, budget - position))::BIGINT AS taken, min(position) AS first_position
  FROM o, b WHERE position < budget GROUP BY source, nth)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0) AS taken, g.first_position
FROM q LEFT JOIN g ON q.source IS NOT DISTINCT FROM g.source AND q.nth = g.nth
"""
