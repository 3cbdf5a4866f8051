"""Range, band, nearest and gap joins: parts, events, orders and customers as places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import dedup, joins
from tidewell.session import table


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def windows(spark, sf_dir):
    """Each part's price lies in windows of 25 around every 12.5th price, half open, as isolation windows overlap."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("mz"), "p_size")
    edges = table(spark, sf_dir, "part").agg(F.floor(F.min("p_retailprice") / 12.5).alias("a"), F.floor(F.max("p_retailprice") / 12.5).alias("b"))
    centers = edges.select(F.explode(F.sequence("a", "b")).alias("k"))
    return parts, centers.select("k", (F.col("k") * 12.5 - 12.5).alias("low"), (F.col("k") * 12.5 + 12.5).alias("high"))


def interval(spark, sf_dir):
    parts, ranges = windows(spark, sf_dir)
    return joins.range_join(parts, ranges, "mz", "low", "high", 25.0).select("p_partkey", "k")


def closed_interval(spark, sf_dir):
    parts, ranges = windows(spark, sf_dir)
    return joins.range_join(parts, ranges, "mz", "low", "high", 25.0, closed=True).groupBy("k").agg(F.count("*").alias("n"))


def band(spark, sf_dir):
    """Order lines of one part whose quantities differ by one at most."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", F.col("l_orderkey").alias("o2"), F.col("l_linenumber").alias("n2"), F.col("l_quantity").cast("double").alias("q2"))
    met = joins.band_join(lines, returned, ["l_partkey"], "q", "q2", 1.0)
    return met.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("q") - F.col("q2"))).alias("distance"))


def nearest_value(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE, F.col("l_quantity").cast("double").alias("q")).distinct()
    theirs = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey", F.col("l_quantity").cast("double").alias("q2")).agg(F.max("l_extendedprice").alias("price"))
    out = joins.nearest_in_band(lines, theirs, ["l_partkey"], [*LINE, "q"], "q", "q2", "price", 2.0)
    return out.select(*LINE, "matched")


def most_intense(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE, F.col("l_quantity").cast("double").alias("q")).distinct()
    theirs = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey", F.col("l_quantity").cast("double").alias("q2")).agg(F.max("l_extendedprice").alias("price"))
    return joins.most_intense_in_band(lines, theirs, ["l_partkey"], [*LINE, "q"], "q", "q2", "price", 2.0)


def event_kinds(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    left = events.filter("event_type = 'click'").select("user_id", "event_id", "at")
    right = events.filter("event_type = 'purchase'").select("user_id", F.col("at").alias("other_at"), F.col("event_id").alias("other_id"))
    return left, right


def nearest(spark, sf_dir):
    left, right = event_kinds(spark, sf_dir)
    return joins.nearest_join(left, right, ["user_id"], "at", "other_at", ["other_id"]).select("event_id", "other_id")


def nearest_within(spark, sf_dir):
    left, right = event_kinds(spark, sf_dir)
    hour = 3_600_000_000
    return joins.nearest_join(left, right, ["user_id"], "at", "other_at", ["other_id"], max_distance=24 * hour).select("event_id", "other_id")


def missing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    places = table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    return joins.gaps(orders, table(spark, sf_dir, "customer").select("c_custkey"), places, ["c_custkey", "o_orderpriority"])


def defaulted(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return joins.with_default(table(spark, sf_dir, "customer").select("c_custkey"), spent, ["c_custkey"], "n_orders", F.lit(0).cast("long"))


def consensus_semi(spark, sf_dir):
    """Lines of orders that a customer of the same nation as the supplier made."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    home = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    return lines.join(orders, "l_orderkey").join(home, "l_suppkey").join(customers, ["o_custkey", "nation"], "left_semi").select("l_orderkey", "l_linenumber")


def best_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice")
    return dedup.best_row(lines, ["l_partkey", "l_linestatus"], F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")


def top_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return dedup.top_rows(lines, ["l_suppkey"], 5, F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")


def library(spark, sf_dir):
    """Lines as catalogue entries by part and status: most quantity wins, ids by key."""
    lines = table(spark, sf_dir, "lineitem").withColumn("names", F.array("l_returnflag")).withColumn("rt", F.col("l_quantity").cast("double"))
    better = [F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    merged = dedup.merge_entries(lines, ["l_partkey", "l_linestatus"], better, ["l_orderkey", "l_linenumber"], "rt", ["names"])
    numbered = dedup.renumbered(merged, ["l_partkey", "l_linestatus"])
    return numbered.select("entry_id", "l_partkey", "l_linestatus", "l_orderkey", "l_linenumber", F.round("rt", 6).alias("rt"), F.array_join("names", ";").alias("names"))


def bounds(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("neg", -F.col("l_extendedprice"))
    return dedup.shared_bounds(lines, ["l_partkey", "l_returnflag"], ["l_orderkey", "l_quantity"], ["neg", "l_orderkey", "l_linenumber"], "l_linestatus")


Q = "l AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity::DOUBLE AS q FROM lineitem), t AS (SELECT l_partkey, l_quantity::DOUBLE AS q2, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"
EVENTS = "c AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click'), p AS (SELECT user_id, epoch_us(ts) AS at, event_id AS other_id FROM events WHERE event_type = 'purchase')"
NEAREST = "n AS (SELECT c.event_id, p.other_id, abs(c.at - p.at) AS d, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.at - p.at), p.at, p.other_id) AS k FROM c LEFT JOIN p USING (user_id))"
RANGES = "k AS (SELECT unnest(generate_series((SELECT floor(min(p_retailprice) / 12.5)::BIGINT FROM part), (SELECT floor(max(p_retailprice) / 12.5)::BIGINT FROM part))) AS k)"

QUERIES = {
    "join_interval": interval,
    "join_interval_closed": closed_interval,
    "join_band": band,
    "join_nearest_in_band": nearest_value,
    "join_most_intense_in_band": most_intense,
    "join_nearest": nearest,
    "join_nearest_within": nearest_within,
    "join_gaps": missing,
    "join_left_default": defaulted,
    "join_consensus_semi": consensus_semi,
    "dedup_best_row": best_lines,
    "top_rows": top_lines,
    "dedup_library": library,
    "dedup_shared_bounds": bounds,
}

ORACLE_SQL = {
    "join_interval": f"WITH {RANGES} SELECT p_partkey, k FROM part JOIN k ON p_retailprice >= k * 12.5 - 12.5 AND p_retailprice < k * 12.5 + 12.5",
    "join_interval_closed": f"WITH {RANGES} SELECT k, count(*) AS n FROM part JOIN k ON p_retailprice BETWEEN k * 12.5 - 12.5 AND k * 12.5 + 12.5 GROUP BY k",
    "join_band": "SELECT a.l_partkey, count(*) AS n, sum(abs(a.l_quantity::DOUBLE - b.l_quantity::DOUBLE)) AS distance FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND b.l_returnflag = 'R' AND abs(a.l_quantity::DOUBLE - b.l_quantity::DOUBLE) <= 1 GROUP BY a.l_partkey",
    "join_nearest_in_band": f"WITH {Q} SELECT l_orderkey, l_linenumber, l.l_partkey, l_suppkey, coalesce(arg_min(price, (abs(q - q2), q2)), 0.0) AS matched FROM l LEFT JOIN t ON l.l_partkey = t.l_partkey AND abs(q - q2) <= 2 GROUP BY l_orderkey, l_linenumber, l.l_partkey, l_suppkey, q",
    "join_most_intense_in_band": f"WITH {Q} SELECT l_orderkey, l_linenumber, l.l_partkey, l_suppkey, q, arg_max(q2, (price, -q2)) AS q2, max(price) AS price FROM l JOIN t ON l.l_partkey = t.l_partkey AND abs(q - q2) <= 2 GROUP BY l_orderkey, l_linenumber, l.l_partkey, l_suppkey, q",
    "join_nearest": f"WITH {EVENTS}, {NEAREST} SELECT event_id, other_id FROM n WHERE k = 1",
    "join_nearest_within": f"WITH {EVENTS}, {NEAREST} SELECT event_id, CASE WHEN d <= 86400000000 THEN other_id END AS other_id FROM n WHERE k = 1",
    "join_gaps": "SELECT c_custkey, o_orderpriority FROM customer, (SELECT DISTINCT o_orderpriority FROM orders) EXCEPT SELECT o_custkey, o_orderpriority FROM orders",
    "join_left_default": "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "join_consensus_semi": "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey AND c_nationkey = s_nationkey",
    "dedup_best_row": "SELECT l_partkey, l_linestatus, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1",
    "top_rows": "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 5",
    "dedup_library": "SELECT row_number() OVER (ORDER BY l_partkey, l_linestatus) - 1 AS entry_id, * FROM (SELECT l_partkey, l_linestatus, arg_max(l_orderkey, (l_quantity, l_extendedprice, l_orderkey, l_linenumber)) AS l_orderkey, arg_max(l_linenumber, (l_quantity, l_extendedprice, l_orderkey, l_linenumber)) AS l_linenumber, round(avg(l_quantity::DOUBLE), 6) AS rt, array_to_string(list_sort(list_distinct(list(l_returnflag))), ';') AS names FROM lineitem GROUP BY l_partkey, l_linestatus)",
    "dedup_shared_bounds": "SELECT l_partkey, l_returnflag, arg_min(l_orderkey, (-l_extendedprice, l_orderkey, l_linenumber)) AS l_orderkey, arg_min(l_quantity, (-l_extendedprice, l_orderkey, l_linenumber)) AS l_quantity, count(DISTINCT l_linestatus) AS n_variants FROM lineitem GROUP BY l_partkey, l_returnflag",
}
