"""Groups of a stream that are given out when complete, or when nothing more of them comes.

State is a map of a group's items, so a batch reads and writes only the items that it
brings, and a few numbers. Timers are in event time: a group that stays incomplete is given
out as such once the watermark has passed its last item by ``idle``; one that was complete
is remembered as long, so items that come again or late do not start it anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps maps and timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GroupCollector(StatefulProcessor):
    def __init__(self, keys: list[str], idle_ms: int):
        self.keys, self.idle_ms = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item bigint", "value double")
        self.head = handle.getValueState("head", "wanted int, last bigint, n int, total double, done boolean")

    def _timer(self, last: int) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(last + self.idle_ms)

    def _row(self, key: tuple, n: int, total: float, complete: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, n, total, complete)], columns=[*self.keys, "n", "total", "complete"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        wanted, last, n, total, done = self.head.get() if self.head.exists() else (0, 0, 0, 0.0, False)
        for part in rows:
            for item, value, expected, at in zip(part["g_item"], part["g_value"], part["g_expected"], part["g_ms"], strict=True):
                wanted, last = max(wanted, int(expected)), max(last, int(at))
                if not done and not self.items.containsKey((int(item),)):
                    self.items.updateValue((int(item),), (float(value),))
                    n, total = n + 1, total + float(value)
        closing = not done and n >= wanted > 0
        if closing:
            self.items.clear()
        self.head.update((wanted, last, n, total, done or closing))
        self._timer(last)
        if closing:
            yield self._row(key, n, total, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, n, total, done = self.head.get() if self.head.exists() else (0, 0, 0, 0.0, True)
        self.items.clear()
        self.head.clear()
        if not done:
            yield self._row(key, n, total, False)

    def close(self) -> None:
        pass


def collected_groups(stream: DataFrame, keys: list[str], item: str, value: str, expected: str, time: str, late: str, idle_seconds: int) -> DataFrame:
    """keys, n, total, complete: each group once, when ``expected`` distinct items have come or none has for ``idle_seconds``.

    Of an item that comes again the first value counts. Rows later than the watermark (``late``) may be left out by Spark.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = dict(stream.dtypes)
    timed = stream.withColumn("g_time", F.col(time).cast("timestamp")).withWatermark("g_time", late)
    rows = timed.select(*keys, "g_time", F.col(item).cast("long").alias("g_item"), F.col(value).cast("double").alias("g_value"), F.col(expected).cast("int").alias("g_expected"), F.unix_millis("g_time").alias("g_ms"))
    shape = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, total double, complete boolean"
    return rows.groupBy(*keys).transformWithStateInPandas(GroupCollector(keys, idle_seconds * 1000), shape, "append", "eventTime")
