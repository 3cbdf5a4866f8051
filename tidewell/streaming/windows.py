"""Streams of measurements: windows by key and time, and groups that close when their last part has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_totals(stream: DataFrame, keys: list[str], time: str, value: str, length: str, late: str) -> DataFrame:
    """keys, start, n, total per time window; a window is final once the watermark has passed it."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    grouped = timed.groupBy(F.window("_t", length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(*keys, F.col("w.start").alias("start"), "n", "total")


def completed_groups(stream: DataFrame, keys: list[str], item: str, value: str, expected: str) -> DataFrame:
    """keys, n, total, complete: a group is given out when ``expected`` distinct items of it have come.

    State is a group's distinct items and sum. Items that come again are counted once, and
    those of a group that has been given out start it anew.
    """
    kinds = dict(stream.dtypes)

    def add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, total = state.get if state.exists else ([], 0.0)
        seen, wanted = set(items), 0
        for part in parts:
            for i, v, n in zip(part[item], part[value], part[expected], strict=True):
                wanted = max(wanted, int(n))
                if int(i) not in seen:
                    seen.add(int(i))
                    total += float(v)
        if len(seen) >= wanted > 0:
            state.remove()
            yield pd.DataFrame([(*key, len(seen), total)], columns=[*keys, "n", "total"])
        else:
            state.update((sorted(seen), total))

    shape = ", ".join(f"{k} {kinds[k]}" for k in keys)
    rows = stream.select(*keys, F.col(item).cast("long").alias(item), F.col(value).cast("double").alias(value), F.col(expected).cast("int").alias(expected))
    return rows.groupBy(*keys).applyInPandasWithState(add, f"{shape}, n long, total double", "items array<long>, total double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything the source holds now, written as Parquet; run again, it goes on where it stopped."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
