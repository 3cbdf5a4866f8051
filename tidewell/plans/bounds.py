"""Extents of the highest peak of each user's events, and peak shapes over lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import emg
from tidewell.operators import bounds
from tidewell.plans.series import KEYS, ORDER, events
from tidewell.session import table


def limits(spark, sf_dir):
    return bounds.limits(events(spark, sf_dir), KEYS, ORDER, "value")


def isolated(spark, sf_dir):
    return bounds.isolated(events(spark, sf_dir), KEYS, ORDER, "value")


def half_widths(spark, sf_dir):
    found = bounds.half_widths(events(spark, sf_dir), KEYS, ORDER, "minute", "value")
    return found.select("user_id", F.round("left_width", 4).alias("left_width"), F.round("right_width", 4).alias("right_width"))


def background(spark, sf_dir):
    found = bounds.background(events(spark, sf_dir), KEYS, ORDER, "minute", "value")
    return found.select("user_id", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n_points")


def best_near(spark, sf_dir):
    """Each order's dearest line among those whose quantity is within 5 of 25."""
    lines = table(spark, sf_dir, "lineitem")
    near = bounds.best_near(lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), ["l_orderkey"], "l_quantity", "l_extendedprice", F.lit(25.0), 5.0)
    return near.select("l_orderkey", "l_extendedprice")


def shapes(spark, sf_dir):
    """Height and share of a tailing peak at each line's quantity, as wide as its discount and tax make it."""
    q, sigma, tau = F.col("l_quantity").cast("double"), F.col("l_discount") * 50 + 0.5, F.col("l_tax") * 50 + 0.5
    mu = F.lit(20.0)
    rows = table(spark, sf_dir, "lineitem").select(F.round(emg.density(q, mu, sigma, tau, F.lit(100.0)), 7).alias("height"), F.round(emg.share_before(q, mu, sigma, tau), 7).alias("share"))
    return rows.groupBy("height", "share").agg(F.count("*").alias("n"))


O = "PARTITION BY user_id ORDER BY ts, event_id"
OUTWARD = f"""p AS (SELECT user_id, row_number() OVER ({O}) - 1 AS i, value AS y, epoch_us(ts) / 6e7 AS x FROM events),
  t AS (SELECT user_id, i AS top_i, y AS top, x AS top_x, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY y DESC, i DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM p) WHERE r = 1),
  o AS (SELECT p.*, top_i, top, top_x, n, side, (i - top_i) * side AS away FROM p JOIN t USING (user_id), (VALUES (-1), (1)) s(side) WHERE (i - top_i) * side >= 0),
  v AS (SELECT *, min(struct_pack(y := y, a := away, i := i)) OVER (w ROWS UNBOUNDED PRECEDING) AS low, min(struct_pack(y := y, a := away, i := i)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o WINDOW w AS (PARTITION BY user_id, side ORDER BY away))"""
ENDS = """f AS (SELECT user_id, side, n, min_by(stop, away) FILTER (stop IS NOT NULL) AS stop FROM e GROUP BY user_id, side, n)
  SELECT user_id, max(coalesce(stop, 0)) FILTER (side = -1)::INT AS left, max(coalesce(stop, n - 1)) FILTER (side = 1)::INT AS right FROM f GROUP BY user_id"""
WIDTHS = """k AS (SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px FROM o WINDOW w AS (PARTITION BY user_id, side ORDER BY away)),
  c AS (SELECT user_id, side, away, abs(px + (py - top / 2) / (py - y) * (x - px) - top_x) AS w FROM k WHERE top > 0 AND py >= top / 2 AND y < top / 2),
  h AS (SELECT user_id, min_by(w, away) FILTER (side = -1) AS l, min_by(w, away) FILTER (side = 1) AS r FROM c GROUP BY user_id),
  hw AS (SELECT user_id, coalesce(l, r) AS left_width, coalesce(r, l) AS right_width FROM (SELECT user_id, CASE WHEN l > 0 THEN l END AS l, CASE WHEN r > 0 THEN r END AS r FROM h) WHERE l IS NOT NULL OR r IS NOT NULL)"""
RATIO, Z = "((l_discount * 50 + 0.5) / (l_tax * 50 + 0.5))", "((l_quantity - 20.0) / (l_discount * 50 + 0.5))"


def _erfc(x: str) -> str:
    t = f"(1 / (1 + {emg.RATE} * abs({x})))"
    poly = "0.0"
    for c in reversed(emg.TERMS):
        poly = f"{t} * ({c} + {poly})"
    return f"(CASE WHEN {x} >= 0 THEN {poly} * exp(-({x}) * ({x})) ELSE 2 - ({poly}) * exp(-({x}) * ({x})) END)"


QUERIES = {
    "bounds_limits": limits,
    "bounds_isolated": isolated,
    "bounds_half_widths": half_widths,
    "bounds_background": background,
    "bounds_best_near": best_near,
    "bounds_tailing_shapes": shapes,
}
ORACLE_SQL = {
    "bounds_limits": f"WITH {OUTWARD}, e AS (SELECT user_id, side, away, n, CASE WHEN away > 0 THEN CASE WHEN y >= before.y AND before.y < top / 2 AND before.y < y / 2 THEN before.i WHEN y < top * 0.05 THEN i END END AS stop FROM v), {ENDS}",
    "bounds_isolated": f"WITH {OUTWARD}, e AS (SELECT user_id, side, away, n, CASE WHEN n >= 3 AND away > 0 AND y - low.y > top * 0.05 THEN low.i END AS stop FROM v), {ENDS}",
    "bounds_half_widths": f"WITH {OUTWARD}, {WIDTHS} SELECT user_id, round(left_width, 4) AS left_width, round(right_width, 4) AS right_width FROM hw",
    "bounds_background": f"""WITH {OUTWARD}, {WIDTHS},
      b AS (SELECT o.*, row_number() OVER (PARTITION BY user_id, side ORDER BY away) AS nth FROM o JOIN hw USING (user_id) WHERE n >= 10 AND away > 0 AND abs(x - top_x) > (left_width + right_width) / 2.355 * 1.96)
      SELECT user_id, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS sd, count(*) AS n_points FROM b WHERE nth <= 5 GROUP BY user_id HAVING count(*) >= 4""",
    "bounds_best_near": "SELECT l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem WHERE abs(l_quantity - 25) <= 5 GROUP BY 1",
    "bounds_tailing_shapes": f"""WITH s AS (SELECT {RATIO} AS r, {Z} AS z, l_tax * 50 + 0.5 AS tau FROM lineitem), g AS (SELECT *, 0.5 * r * r - z * r AS e, (r - z) / sqrt(2.0) AS a, -z / sqrt(2.0) AS u, -(z - r) / sqrt(2.0) AS w FROM s),
      h AS (SELECT round(CASE WHEN e > 500 THEN 0.0 ELSE 100.0 / (2 * tau) * exp(e) * {_erfc('a')} END, 7) AS height,
        round(CASE WHEN e > 500 THEN 0.5 * {_erfc('u')} ELSE 0.5 * {_erfc('u')} - exp(least(e, 500.0)) * (0.5 * {_erfc('w')}) END, 7) AS share FROM g)
      SELECT height, share, count(*) AS n FROM h GROUP BY 1, 2""",
}
