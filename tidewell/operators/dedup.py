"""Keeping one row of many: catalogue entries, best rows, shared bounds, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_row(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each ``keys`` by ``order``, which must be total to give the same row again."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def top_rows(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each ``keys`` with their ``rank`` from 1."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def merge_entries(df: DataFrame, keys: list[str], better: list[Column], keep: list[str], average: str, unite: list[str]) -> DataFrame:
    """One row per ``keys``: ``keep`` of the best row, the mean of ``average``, the sorted distinct union of each array in ``unite``.

    ``better``: what makes a row the best, most important first; it should end in a unique value.
    """
    unions = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in unite]
    best = F.max_by(F.struct(*keep), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(better)])).alias("_best")
    merged = df.groupBy(*keys).agg(best, F.avg(average).alias(average), *unions)
    return merged.select(*keys, "_best.*", average, *unite)


def renumbered(df: DataFrame, order: list[str], name: str = "entry_id") -> DataFrame:
    """Adds ids from 0 in the order of ``order``: places within ranges plus the rows of the ranges before."""
    from tidewell.storage import stored

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))
    nth = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_nth", nth).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def shared_bounds(df: DataFrame, keys: list[str], bounds: list[str], rank: list[str], variant: str) -> DataFrame:
    """keys, the bounds of the best row by ``rank``, and how many variants share them."""
    best = F.min_by(F.struct(*bounds), F.struct(*rank)).alias("_b")
    return df.groupBy(*keys).agg(best, F.count_distinct(variant).alias("n_variants")).select(*keys, "_b.*", "n_variants")
