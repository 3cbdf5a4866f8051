"""Running sums over all rows of a key in two steps: totals of sorted ranges first, rows within a range second."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.storage import stored

PART = "_part"


def ranged(df: DataFrame, keys: list[str], order: list[Column], name: str = "ranges") -> DataFrame:
    """``df`` in ranges of the order by keys and ``order``; ``_part`` numbers them. Stored, so the ranges stay as they are, whatever is computed again."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()), name)


def matched(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``other`` of equal keys; null keys equal each other."""
    named = other.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
    return rows.join(named, reduce(lambda x, y: x & y, same), how).drop(*[f"_k_{i}" for i in range(len(keys))])


def with_running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` of ``ranged`` with, for each name, the sum over the key's rows up to and with this one."""
    totals = rows.groupBy(*keys, PART).agg(*[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()])
    over = W.partitionBy(*keys).orderBy(PART)
    before = totals.select(*keys, PART, *[(F.sum(f"_of_{n}").over(over) - F.col(f"_of_{n}")).alias(f"_of_{n}") for n in sums])
    within = W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return matched(rows, before, [*keys, PART]).select(*rows.columns, *[(F.col(f"_of_{n}") + F.sum(c).over(within)).alias(n) for n, c in sums.items()])
