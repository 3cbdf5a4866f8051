"""Robust statistics, calibration, sampling and alignment over orders, lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import align, stats
from tidewell.session import table


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double").alias("day"))


def weighted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("w"))
    return stats.weighted_median(orders(spark, sf_dir).join(lines, "o_orderkey"), ["o_custkey"], "o_totalprice", "w")


def mad(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("r", F.col("value") - 50.0)
    return stats.clipped_mad(rows, ["user_id"], "r", 30.0).withColumn("mad", F.round("mad", 9))


def calibration(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("error", F.col("value") - 50.0)
    out = stats.calibration_summary(rows, ["event_type"], "error")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "sd", "tolerance")])


def bins(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", 10.0)


def line_quality(spark, sf_dir):
    rows = orders(spark, sf_dir)
    line = align.line_fit(rows, ["o_orderpriority"], "day", "o_totalprice").drop("n")
    fitted = rows.join(line, "o_orderpriority").withColumn("fitted", F.col("slope") * F.col("day") + F.col("intercept"))
    out = stats.fit_quality(fitted, ["o_orderpriority"], "o_totalprice", "fitted")
    return out.select("o_orderpriority", "n", *[F.round(c, 2).alias(c) for c in ("sd", "mean_abs", "largest", "p20", "p80", "mad")])


def lines_fit(spark, sf_dir):
    out = align.line_fit(orders(spark, sf_dir), ["o_orderpriority"], "day", "o_totalprice")
    return out.select("o_orderpriority", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 1).alias("intercept"))


def auc(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("positive", F.col("l_returnflag") == "R")
    return stats.rank_auc(rows, ["l_linenumber"], "l_extendedprice", "positive").withColumn("auc", F.round("auc", 9))


def separating(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("positive", F.col("l_returnflag") == "R")
    return stats.best_separating(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "positive").withColumn("auc", F.round("auc", 9))


def standard(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return stats.standardized(rows, ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 6).alias("z"))


def fold_of(spark, sf_dir):
    return stats.folds(table(spark, sf_dir, "lineitem"), "l_partkey", 3)


def sampled(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double").alias("day"))
    return stats.stratified_sample(rows, "day", "o_totalprice", "o_orderkey", 500).select("o_orderkey")


def agreed(spark, sf_dir):
    """Parts over return flags as runs: where their lines agree."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", (F.col("l_tax") * 100).alias("width"), ((F.col("l_discount") - 0.05) * 20).alias("score"), "l_returnflag")
    out = align.consensus(rows, ["l_partkey"], "l_quantity", "width", "score", "l_returnflag")
    return out.select("l_partkey", "l_quantity", F.round("width", 6).alias("width"), "n_runs", F.round("mad", 6).alias("mad"))


def planned(spark, sf_dir):
    """Each supplier's lines against its mean quantity: keep, move to another line's quantity, or force."""
    lines = table(spark, sf_dir, "lineitem")
    mean = lines.groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 3).alias("expected"))
    candidates = lines.groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_quantity")).alias("candidates"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").join(mean, "l_suppkey").join(candidates, "l_partkey")
    action = align.reconcile_action(F.col("l_quantity"), F.col("candidates"), F.col("expected"), F.lit(1.0), F.lit(0.5))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", action.alias("a")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "a.action", "a.place")


def diverging(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_discount") * 100).alias("width"), "l_extendedprice")
    rank = [-F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return align.diverging_siblings(rows, ["l_orderkey"], "l_quantity", "width", rank).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "target")


ORD = "o AS (SELECT *, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS day FROM orders)"
FIT = "f AS (SELECT o_orderpriority, CASE WHEN v > 1e-12 THEN c / v ELSE 0.0 END AS slope, my - CASE WHEN v > 1e-12 THEN c / v ELSE 0.0 END * mx AS intercept, n FROM (SELECT o_orderpriority, avg(day * o_totalprice) - avg(day) * avg(o_totalprice) AS c, avg(day * day) - avg(day) * avg(day) AS v, avg(day) AS mx, avg(o_totalprice) AS my, count(*) AS n FROM o GROUP BY 1))"


def auc_sql(rows: str) -> str:
    return f"""e AS (SELECT k, v, sum(pos::INT) AS p, count(*) AS n FROM {rows} GROUP BY k, v),
      b AS (SELECT *, coalesce(sum(n - p) OVER (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM e),
      a AS (SELECT k, CASE WHEN sum(p) * sum(n - p) > 0 THEN sum(p * below + p * (n - p) / 2.0) / (sum(p) * sum(n - p)) ELSE 0.5 END AS auc FROM b GROUP BY k)"""


def median_sql(value: str) -> str:
    return f"""SELECT l_partkey, min(v) AS m FROM (SELECT l_partkey, v, sum(w) OVER (PARTITION BY l_partkey ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY l_partkey) AS al
      FROM (SELECT l_partkey, {value} AS v, sum(w) AS w FROM r GROUP BY 1, 2)) WHERE upto * 2 >= al GROUP BY 1"""


QUERIES = {
    "stats_weighted_median": weighted,
    "stats_clipped_mad": mad,
    "stats_calibration_summary": calibration,
    "stats_histogram": bins,
    "stats_fit_quality": line_quality,
    "stats_line_fit": lines_fit,
    "stats_rank_auc": auc,
    "stats_best_separating": separating,
    "stats_standardize": standard,
    "stats_folds": fold_of,
    "stats_stratified_sample": sampled,
    "align_consensus": agreed,
    "align_reconcile_plan": planned,
    "align_diverging_siblings": diverging,
}
ORACLE_SQL = {
    "stats_weighted_median": """SELECT o_custkey, min(o_totalprice) AS median FROM (SELECT o_custkey, o_totalprice, sum(w) OVER (PARTITION BY o_custkey ORDER BY o_totalprice ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY o_custkey) AS al
      FROM (SELECT o_custkey, o_totalprice, sum(n) AS w FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1, 2)) WHERE upto * 2 >= al GROUP BY 1""",
    "stats_clipped_mad": "SELECT user_id, round(u[len(u) // 2 + 1], 9) AS mad FROM (SELECT user_id, CASE WHEN len(list_filter(v, lambda x: x <= 30)) < 20 THEN v ELSE list_filter(v, lambda x: x <= 30) END AS u FROM (SELECT user_id, list_sort(list(abs(value - 50.0))) AS v FROM events GROUP BY 1))",
    "stats_calibration_summary": "SELECT event_type, count(value) AS n, round(avg(value - 50.0), 6) AS mean, round(median(value - 50.0), 6) AS median, round(stddev_samp(value - 50.0), 6) AS sd, round(abs(avg(value - 50.0)) + 3 * stddev_samp(value - 50.0), 6) AS tolerance FROM events GROUP BY 1",
    "stats_histogram": """WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi, greatest(ceil((max(value) - min(value)) / 10.0), 1)::INT AS b FROM events GROUP BY 1),
      c AS (SELECT event_type, least(floor((value - lo) / 10.0), b - 1)::INT AS bin, count(*) AS n FROM events JOIN e USING (event_type) GROUP BY 1, 2)
      SELECT e.event_type, g.bin::INT AS bin, coalesce(n, 0) AS n FROM e, unnest(generate_series(0, b - 1)) g(bin) LEFT JOIN c ON c.event_type = e.event_type AND c.bin = g.bin""",
    "stats_fit_quality": f"""WITH {ORD}, {FIT}, r AS (SELECT o_orderpriority, o_totalprice - (slope * day + intercept) AS r FROM o JOIN f USING (o_orderpriority)),
      v AS (SELECT o_orderpriority, count(*) AS n, stddev_samp(r) AS sd, avg(abs(r)) AS mean_abs, max(abs(r)) AS largest, list_sort(list(abs(r))) AS v FROM r GROUP BY 1)
      SELECT o_orderpriority, n, round(sd, 2) AS sd, round(mean_abs, 2) AS mean_abs, round(largest, 2) AS largest, round(v[round(0.2 * (n - 1))::INT + 1], 2) AS p20, round(v[round(0.8 * (n - 1))::INT + 1], 2) AS p80, round((v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2, 2) AS mad FROM v""",
    "stats_line_fit": f"WITH {ORD}, {FIT} SELECT o_orderpriority, n, round(slope, 4) AS slope, round(intercept, 1) AS intercept FROM f",
    "stats_rank_auc": f"WITH r AS (SELECT l_linenumber AS k, l_extendedprice AS v, l_returnflag = 'R' AS pos FROM lineitem), {auc_sql('r')} SELECT k AS l_linenumber, round(auc, 9) AS auc FROM a",
    "stats_best_separating": f"WITH r AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS k, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v, l_returnflag = 'R' AS pos FROM lineitem), {auc_sql('r')} SELECT k AS feature, round(auc, 9) AS auc FROM a ORDER BY abs(a.auc - 0.5) DESC, k LIMIT 1",
    "stats_standardize": "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS z FROM orders",
    "stats_folds": "SELECT l_partkey, ((row_number() OVER (ORDER BY l_partkey) - 1) % 3)::INT AS fold FROM (SELECT DISTINCT l_partkey FROM lineitem)",
    "stats_stratified_sample": f"""WITH {ORD}, e AS (SELECT count(*) AS n, min(day) AS a, max(day) AS b, min(o_totalprice) AS c, max(o_totalprice) AS d FROM o),
      p AS (SELECT o_orderkey, n, row_number() OVER (PARTITION BY least(floor((day - a) / greatest((b - a) / 16, 1e-12)), 15), least(floor((o_totalprice - c) / greatest((d - c) / 16, 1e-12)), 15) ORDER BY o_orderkey) AS k FROM o, e)
      SELECT o_orderkey FROM p WHERE n <= 500 OR k <= 2""",
    "align_consensus": f"""WITH r AS (SELECT l_partkey, l_quantity, l_tax * 100 AS width, l_returnflag AS run, greatest(1 / (1 + exp(-((l_discount - 0.05) * 20))), 1e-6) AS w FROM lineitem),
      a AS ({median_sql('l_quantity')}), b AS ({median_sql('width')}),
      s AS (SELECT l_partkey, count(DISTINCT run) AS n_runs, list_sort(list(abs(l_quantity - m))) AS v FROM r JOIN a USING (l_partkey) GROUP BY 1)
      SELECT l_partkey, a.m AS l_quantity, round(b.m, 6) AS width, n_runs, CASE WHEN n_runs >= 3 THEN round((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 6) END AS mad FROM a JOIN b USING (l_partkey) JOIN s USING (l_partkey)""",
    "align_reconcile_plan": """WITH m AS (SELECT l_suppkey, round(avg(l_quantity), 3) AS expected FROM lineitem GROUP BY 1), c AS (SELECT DISTINCT l_partkey, l_quantity AS q FROM lineitem),
      n AS (SELECT l_partkey, l_suppkey, arg_min(q, (abs(q - expected), q)) AS q FROM c JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) USING (l_partkey) JOIN m USING (l_suppkey) WHERE abs(q - expected) <= 1 GROUP BY 1, 2)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN abs(l_quantity - expected) <= 1 THEN 'keep' WHEN q IS NOT NULL THEN 'move' ELSE 'force' END AS action,
        CASE WHEN abs(l_quantity - expected) <= 1 THEN l_quantity WHEN q IS NOT NULL THEN q ELSE expected END AS place
      FROM lineitem JOIN m USING (l_suppkey) LEFT JOIN n USING (l_partkey, l_suppkey)""",
    "align_diverging_siblings": """WITH b AS (SELECT l_orderkey, arg_min(l_quantity, (-l_extendedprice, l_linenumber, l_partkey, l_suppkey)) AS target, arg_min(l_discount * 100, (-l_extendedprice, l_linenumber, l_partkey, l_suppkey)) AS bw FROM lineitem GROUP BY 1)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, target FROM lineitem JOIN b USING (l_orderkey) WHERE abs(l_quantity - target) > greatest(bw / 2, 0.1)""",
}
