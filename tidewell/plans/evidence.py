"""Pairs, peptides' best scores, gates, samples, chance matches and merged peaks, over lines, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import evidence
from tidewell.plans.competition import ROWS, scored
from tidewell.session import table


def paired(spark, sf_dir):
    return evidence.paired(scored(spark, sf_dir), ["run", "base"], ["score", "line"])


def peptide_scores(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("q", F.col("line") / 10.0)
    return evidence.peptide_scores(rows, ["run", "base", "line", "score"])


def qualifying(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    passes = evidence.qualifies(F.col("l_linenumber") % 2 == 0, F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, 0.04, 0.5)
    return lines.filter(passes).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def mass_gate(spark, sf_dir):
    """Lines whose price a piece is near its part's mean, by three standard deviations, or by a fixed bound for parts of one line."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("error"))
    means = evidence.mass_errors(lines, ["l_partkey"], "error")
    tolerance = F.when(F.col("sd") > 0, F.col("sd"))
    kept = lines.join(means, "l_partkey").filter(evidence.within_mass_error(F.col("error"), F.col("mean"), tolerance, 1.0))
    return kept.groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.max("mean_abs"), 6).alias("mean_abs"), F.round(F.max("sd"), 6).alias("sd"))


def spread(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.col("o_totalprice").alias("x"))
    return evidence.spread_sample(rows, ["o_orderpriority"], "x", ["x", "o_orderkey"], 20, 3)


def groups(spark, sf_dir):
    """Whole orders in at most half of the lines, with their number of lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return evidence.whole_groups(lines, "l_orderkey", lines.count() // 2).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def chances(spark, sf_dir):
    """Each supplier's best line by price a piece, and how many as good are to be expected by chance."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") * 10 + F.col("l_extendedprice") / 100000).alias("score"))
    return evidence.expectation(lines, ["l_suppkey"], "score").select("l_suppkey", "best", F.round(F.log10("e_value"), 5).alias("log_e"))


def merged(spark, sf_dir):
    """Each user's values, those within 1.5 of the first of a group as one."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("value").alias("mz"), F.lit(1.0).alias("intensity"))).alias("peaks"))
    peaks = rows.select("user_id", F.inline(evidence.merged_peaks(F.col("peaks"), 1.5)))
    return peaks.select("user_id", F.round("mz", 6).alias("mz"), F.round("intensity", 3).alias("intensity"))


QUERIES = {
    "evidence_paired": paired,
    "evidence_peptide_scores": peptide_scores,
    "evidence_qualifying": qualifying,
    "evidence_mass_gate": mass_gate,
    "evidence_spread_sample": spread,
    "evidence_whole_groups": groups,
    "evidence_expectation": chances,
    "evidence_merged_peaks": merged,
}
ORACLE_SQL = {
    "evidence_paired": f"WITH {ROWS} SELECT run, base, max(score) FILTER (NOT decoy) AS target_score, max(score) FILTER (decoy) AS decoy_score, max(line) FILTER (NOT decoy) AS target_line, max(line) FILTER (decoy) AS decoy_line FROM r GROUP BY run, base HAVING count(DISTINCT decoy) = 2",
    "evidence_peptide_scores": f"WITH {ROWS} SELECT peptide, max(score) AS score, min(line / 10.0) AS q, min_by(decoy, struct_pack(a := run, b := base, c := line, d := score)) AS decoy FROM r GROUP BY peptide",
    "evidence_qualifying": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber % 2 <> 0 AND l_discount <= 0.04 AND (l_tax <= 0.04 OR l_quantity / 50 <= 0.5) GROUP BY 1",
    "evidence_mass_gate": """WITH e AS (SELECT l_partkey, l_extendedprice / l_quantity / 1000 AS error FROM lineitem), m AS (SELECT l_partkey, avg(error) AS mean, avg(abs(error)) AS mean_abs, stddev_pop(error) AS sd FROM e GROUP BY 1)
      SELECT l_partkey, count(*) AS n, round(max(mean_abs), 6) AS mean_abs, round(max(sd), 6) AS sd FROM e JOIN m USING (l_partkey) WHERE CASE WHEN sd > 0 THEN abs(error - mean) <= sd ELSE abs(error) <= 1 END GROUP BY 1""",
    "evidence_spread_sample": """WITH o AS (SELECT o_orderpriority, o_orderkey, o_totalprice AS x, min(o_totalprice) OVER p AS lo, max(o_totalprice) OVER p AS hi FROM orders WINDOW p AS (PARTITION BY o_orderpriority)),
      b AS (SELECT *, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 20), 19) ELSE 0 END AS bin FROM o)
      SELECT o_orderpriority, o_orderkey, x FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, bin ORDER BY x, o_orderkey) AS nth FROM b) WHERE nth <= 3""",
    "evidence_whole_groups": """WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
      u AS (SELECT *, sum(n) OVER (ORDER BY md5('42:' || l_orderkey::VARCHAR), l_orderkey ROWS UNBOUNDED PRECEDING) AS upto FROM g)
      SELECT l_orderkey, n FROM u WHERE upto <= (SELECT count(*) // 2 FROM lineitem)""",
    "evidence_expectation": """WITH b AS (SELECT l_suppkey, l_discount * 10 + l_extendedprice / 100000 AS score FROM lineitem),
      c AS (SELECT l_suppkey, CASE WHEN score > 0 THEN least(floor(score * 50 + 0.5)::INT, 151) ELSE -1 END AS bin, count(*) AS n, max(score) AS best FROM b GROUP BY ALL),
      h AS (SELECT l_suppkey, max(best) AS best, sum(n) AS total FROM c GROUP BY 1),
      s AS (SELECT *, lead(bin) OVER (PARTITION BY l_suppkey ORDER BY bin) - bin AS step FROM c WHERE bin BETWEEN 0 AND 150),
      e AS (SELECT l_suppkey, coalesce(min(bin) FILTER (bin >= 5 AND step > 2), max(bin) FILTER (step IS NOT NULL)) AS last FROM s GROUP BY 1),
      r AS (SELECT s.l_suppkey, bin, last, log10(sum(n) OVER (PARTITION BY s.l_suppkey ORDER BY bin DESC)) AS reach FROM s JOIN e USING (l_suppkey) WHERE bin <= last),
      l AS (SELECT l_suppkey, regr_slope(reach, bin) AS slope, regr_intercept(reach, bin) AS zero, count(*) AS filled FROM r WHERE bin > last - 10 GROUP BY 1)
      SELECT l_suppkey, best, round(log10(CASE WHEN total >= 10 AND filled >= 3 AND slope < 0 THEN least(pow(10, greatest(least(slope * 50 * best + zero, 10), -10)), 999) ELSE 999 END), 5) AS log_e FROM h LEFT JOIN l USING (l_suppkey)""",
    "evidence_merged_peaks": """WITH RECURSIVE v AS (SELECT user_id, list_sort(list(value)) AS l FROM events GROUP BY 1),
      g AS (SELECT user_id, l, 1 AS k, len(list_filter(l, lambda x: x - l[1] <= 1.5)) AS n FROM v
        UNION ALL SELECT user_id, l, k + n, len(list_filter(l[k + n:], lambda x: x - l[k + n] <= 1.5)) FROM g WHERE k + n <= len(l))
      SELECT user_id, round(list_avg(l[k:k + n - 1]), 6) AS mz, n::DOUBLE AS intensity FROM g""",
}
