"""Series analytics: each user's events in time order, and each part's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import series
from tidewell.session import table

KEYS, ORDER = ["user_id"], ["ts", "event_id"]


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 6e7).alias("minute"))


def smoothed(spark, sf_dir):
    return series.smooth(events(spark, sf_dir), KEYS, ORDER, "value").select("event_id", F.round("smoothed", 6).alias("smoothed"))


def maxima(spark, sf_dir):
    return series.local_maxima(events(spark, sf_dir), KEYS, ORDER, "value", 50.0).select("user_id", "event_id", "value")


def runs(spark, sf_dir):
    return series.runs_above(events(spark, sf_dir), KEYS, ORDER, "value", 40.0, 3).withColumn("total", F.round("total", 6))


def area(spark, sf_dir):
    return series.trapezoid(events(spark, sf_dir), KEYS, ORDER, "minute", "value").select("user_id", F.round(F.col("area") / 1000, 3).alias("area"))


def apexes(spark, sf_dir):
    return series.apex(events(spark, sf_dir), KEYS, ORDER, "value").select("user_id", "event_id", "value")


def dense(spark, sf_dir):
    return series.dense_windows(events(spark, sf_dir), KEYS, ORDER, F.col("value") >= 60.0)


def noise(spark, sf_dir):
    return series.signal_to_noise(events(spark, sf_dir), KEYS, ORDER, "value").select("user_id", F.round("snr", 5).alias("snr"))


def local_tolerance(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("residual", F.col("value") - 50.0)
    return series.moving_mean_deviation(rows, KEYS, ORDER, "residual").select("event_id", F.round(F.greatest(F.col("local") * 3.0, F.lit(0.5)), 6).alias("tolerance"))


O = "PARTITION BY user_id ORDER BY ts, event_id"
QUERIES = {
    "series_smoothing": smoothed,
    "series_local_maxima": maxima,
    "series_runs_above": runs,
    "series_trapezoid": area,
    "series_apex": apexes,
    "series_dense_windows": dense,
    "series_signal_to_noise": noise,
    "series_local_tolerance": local_tolerance,
}
ORACLE_SQL = {
    "series_smoothing": f"SELECT event_id, round(CASE WHEN lag(value, 2) OVER o IS NOT NULL AND lead(value, 2) OVER o IS NOT NULL THEN greatest((-3 * lag(value, 2) OVER o + 12 * lag(value) OVER o + 17 * value + 12 * lead(value) OVER o - 3 * lead(value, 2) OVER o) / 35.0, 0.0) ELSE value END, 6) AS smoothed FROM events WINDOW o AS ({O})",
    "series_local_maxima": f"SELECT user_id, event_id, value FROM (SELECT *, lag(value) OVER o AS l, lead(value) OVER o AS r FROM events WINDOW o AS ({O})) WHERE coalesce(value >= l, true) AND coalesce(value >= r, true) AND value >= 50",
    "series_runs_above": f"""WITH p AS (SELECT *, row_number() OVER ({O}) - 1 AS i FROM events),
      s AS (SELECT *, i - row_number() OVER ({O}) AS g FROM p WHERE value >= 40)
      SELECT user_id, min(i) AS run_start, max(i) AS run_end, count(*) AS n_points, max(value) AS apex, round(sum(value), 6) AS total FROM s GROUP BY user_id, g HAVING count(*) >= 3""",
    "series_trapezoid": f"SELECT user_id, round(sum(coalesce(part, 0.0)) / 1000, 3) AS area FROM (SELECT user_id, (value + lag(value) OVER o) / 2 * (m - lag(m) OVER o) AS part FROM (SELECT *, epoch_us(ts) / 6e7 AS m FROM events) WINDOW o AS ({O})) GROUP BY user_id",
    "series_apex": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "series_dense_windows": f"SELECT DISTINCT user_id FROM (SELECT user_id, row_number() OVER ({O}) AS i, count(*) FILTER (value >= 60) OVER ({O} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE i >= 4 AND n >= 3",
    "series_signal_to_noise": f"""WITH p AS (SELECT user_id, value AS y, row_number() OVER ({O}) AS i FROM events),
      t AS (SELECT user_id, max((y, i)) AS top FROM p GROUP BY user_id),
      s AS (SELECT user_id, max(top[1]) AS a, avg(y) FILTER (abs(i - top[2]) BETWEEN 3 AND 7) AS m, stddev_pop(y) FILTER (abs(i - top[2]) BETWEEN 3 AND 7) AS s FROM p JOIN t USING (user_id) GROUP BY user_id)
      SELECT user_id, round(CASE WHEN m IS NULL THEN 0.0 WHEN s > 1e-10 THEN greatest((a - m) / s, 0.0) WHEN abs(m) > 1e-10 THEN a / m WHEN a > 0 THEN a * 100 ELSE 0.0 END, 5) AS snr FROM s""",
    "series_local_tolerance": f"SELECT event_id, round(greatest(3.0 * avg(abs(value - 50.0)) OVER ({O} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0.5), 6) AS tolerance FROM events",
}
