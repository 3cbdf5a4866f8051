"""Competition and error rates: order lines as scored rows, orders as pairs, return flags as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import fdr
from tidewell.session import table


def scored(spark, sf_dir):
    """base, decoy, score, run, peptide of every order line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("base"),
        (F.col("l_linenumber") % 2 == 0).alias("decoy"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_returnflag").alias("run"),
        F.col("l_partkey").alias("peptide"),
        F.col("l_linenumber").alias("line"),
    )


def pairs(spark, sf_dir):
    return fdr.compete(scored(spark, sf_dir), ["base"])


def experiment(spark, sf_dir):
    return fdr.experiment_q_values(scored(spark, sf_dir)).select("base", "decoy", "score", F.round("q", 9).alias("q"))


def runs(spark, sf_dir):
    return fdr.run_q_values(scored(spark, sf_dir)).select("run", "base", "decoy", "score", F.round("q", 9).alias("q"))


def training(spark, sf_dir):
    return fdr.q_values(pairs(spark, sf_dir), ["base"], fdr.TRAINING).select("base", "decoy", F.round("q", 9).alias("q"))


def calibration(spark, sf_dir):
    return fdr.q_values(pairs(spark, sf_dir), ["base"], fdr.CALIBRATION).select("base", "decoy", F.round("q", 9).alias("q"))


def unpaired(spark, sf_dir):
    rows = scored(spark, sf_dir).select((F.col("base") * 8 + F.col("line")).alias("id"), "decoy", "score")
    return fdr.q_values(rows, ["id"], fdr.TRAINING).filter("NOT decoy").select("id", F.round("q", 9).alias("q"))


def thresholds(spark, sf_dir):
    return fdr.counts_at(fdr.q_values(pairs(spark, sf_dir), ["base"]), (0.5, 0.6, 0.7, 0.8))


def accepted(spark, sf_dir):
    return fdr.accepted_targets(pairs(spark, sf_dir), ["base"], 0.6).select("base", "score")


def peptides(spark, sf_dir):
    best = fdr.best_per_peptide(scored(spark, sf_dir), order=("base", "line"))
    return best.select("peptide", "base", "line", "score", "decoy")


def compacted(spark, sf_dir):
    rows = scored(spark, sf_dir)
    passing = fdr.q_values(fdr.compete(rows, ["run", "base"]), ["base"], partition=["run"]).filter("q <= 0.6")
    return fdr.compact(rows, passing).groupBy("run", "decoy").agg(F.count("*").alias("n"), F.countDistinct("base").alias("n_pairs"))


def levels(spark, sf_dir):
    rows = scored(spark, sf_dir)
    run_q = fdr.run_q_values(rows).select("run", "base", "decoy", F.col("q").alias("precursor_q"))
    by_peptide = fdr.compete(rows.select("run", F.col("peptide").alias("base"), "decoy", "score"), ["run", "base"])
    peptide_q = fdr.q_values(by_peptide, ["base"], partition=["run"]).select("run", F.col("base").alias("peptide"), F.col("decoy").alias("peptide_decoy"), F.col("q").alias("peptide_q"))
    one = F.lit(1.0)
    peptide_q = peptide_q.withColumnRenamed("peptide_decoy", "decoy")
    joined = rows.join(run_q, ["run", "base", "decoy"], "left").join(peptide_q, ["run", "peptide", "decoy"], "left")
    q = fdr.effective_q(F.coalesce("precursor_q", one), F.coalesce("peptide_q", one), one, "both")
    return joined.select("run", "base", "line", F.round(q, 9).alias("q"))


def all_levels(spark, sf_dir):
    out = fdr.all_levels(scored(spark, sf_dir), ["line", "base", "peptide", "score"])
    names = ("run_precursor_q", "run_peptide_q", "exp_precursor_q", "exp_peptide_q")
    return out.select("run", "base", "line", "peptide", *[F.round(n, 9).alias(n) for n in names])


def picked(spark, sf_dir):
    """Groups are suppliers, members their parts, scores the best line of each part and class."""
    rows = scored(spark, sf_dir)
    best = rows.groupBy("peptide", "decoy").agg(F.max("score").alias("score"), F.min(F.col("line") / 10.0).alias("best_q"))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group_id"), F.col("l_partkey").alias("peptide")).distinct()
    return fdr.picked_groups(members, best, 0.1).select("group_id", "decoy", "score", F.round("q", 9).alias("q"))


def simple_by_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select("doc_id", (F.col("quality") == 0).alias("decoy"), F.col("n_chars").cast("double").alias("score"))
    return fdr.q_values(rows, ["doc_id"], fdr.TRAINING).select("doc_id", "decoy", F.round("q", 9).alias("q"))


ROWS = "r AS (SELECT l_orderkey AS base, l_linenumber % 2 = 0 AS decoy, l_extendedprice AS score, l_returnflag AS run, l_partkey AS peptide, l_linenumber AS line FROM lineitem)"
SIDES = "max(score) FILTER (NOT decoy) AS t, max(score) FILTER (decoy) AS d"
WINS = "t IS NOT NULL AND coalesce(t > d, true)"


def winners(keys: str, rows: str = "r") -> str:
    return f"w AS (SELECT {keys}, CASE WHEN {WINS} THEN t ELSE d END AS score, NOT ({WINS}) AS decoy FROM (SELECT {keys}, {SIDES} FROM {rows} GROUP BY {keys}))"


def rated(tie: str, raw: str, partition: str = "", rows: str = "w") -> str:
    by = f"PARTITION BY {partition} " if partition else ""
    return f"""c AS (SELECT *, count(*) FILTER (NOT decoy) OVER o AS nt, count(*) FILTER (decoy) OVER o AS nd FROM {rows} WINDOW o AS ({by}ORDER BY score DESC, {tie} ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, least(1.0, min({raw}) OVER ({by}ORDER BY score DESC, {tie} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM c)"""


def levelled(name: str, rows: str, keys: str, partition: str) -> str:
    """Winning rows by keys of the best rows, and their q-values, as table ``name``."""
    by = f"PARTITION BY {partition} " if partition else ""
    return f"""{name}_b AS (SELECT *, row_number() OVER (PARTITION BY {keys}, decoy ORDER BY score DESC, line, base, peptide) AS n_ FROM {rows}),
      {name}_s AS (SELECT *, max(score) FILTER (decoy) OVER (PARTITION BY {keys}) AS d_, max(score) FILTER (NOT decoy) OVER (PARTITION BY {keys}) AS t_ FROM {name}_b WHERE n_ = 1),
      {name}_w AS (SELECT * FROM {name}_s WHERE CASE WHEN decoy THEN t_ IS NULL OR t_ <= d_ ELSE d_ IS NULL OR t_ > d_ END),
      {name}_c AS (SELECT *, count(*) FILTER (NOT decoy) OVER o AS nt, count(*) FILTER (decoy) OVER o AS nd FROM {name}_w WINDOW o AS ({by}ORDER BY score DESC, base ROWS UNBOUNDED PRECEDING)),
      {name} AS (SELECT *, least(1.0, min({REPORTED}) OVER ({by}ORDER BY score DESC, base ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM {name}_c)"""


REPORTED = "CASE WHEN nt = 0 THEN 1.0 ELSE (nd + 1) / nt END"
TRAINING = "CASE WHEN nt = 0 THEN 1.0 ELSE nd / nt END"
CALIBRATION = "nd / greatest(nt, 1)"

QUERIES = {
    "fdr_pair_competition": pairs,
    "fdr_experiment_qvalues": experiment,
    "fdr_run_qvalues": runs,
    "fdr_training_qvalues": training,
    "fdr_calibration_qvalues": calibration,
    "fdr_unpaired_qvalues": unpaired,
    "fdr_counts_at_thresholds": thresholds,
    "fdr_accepted_targets": accepted,
    "fdr_best_per_peptide": peptides,
    "fdr_compaction": compacted,
    "fdr_effective_level": levels,
    "fdr_all_levels": all_levels,
    "fdr_picked_groups": picked,
    "fdr_simple_by_quality": simple_by_quality,
}

ORACLE_SQL = {
    "fdr_pair_competition": f"WITH {ROWS}, {winners('base')} SELECT * FROM w",
    "fdr_experiment_qvalues": f"WITH {ROWS}, {winners('base')}, {rated('base', REPORTED)} SELECT base, decoy, score, round(q, 9) AS q FROM q",
    "fdr_run_qvalues": f"WITH {ROWS}, {winners('run, base')}, {rated('base', REPORTED, 'run')} SELECT run, base, decoy, score, round(q, 9) AS q FROM q",
    "fdr_training_qvalues": f"WITH {ROWS}, {winners('base')}, {rated('base', TRAINING)} SELECT base, decoy, round(q, 9) AS q FROM q",
    "fdr_calibration_qvalues": f"WITH {ROWS}, {winners('base')}, {rated('base', CALIBRATION)} SELECT base, decoy, round(q, 9) AS q FROM q",
    "fdr_unpaired_qvalues": f"WITH {ROWS}, u AS (SELECT base * 8 + line AS id, decoy, score FROM r), {rated('id', TRAINING, rows='u')} SELECT id, round(q, 9) AS q FROM q WHERE NOT decoy",
    "fdr_counts_at_thresholds": f"WITH {ROWS}, {winners('base')}, {rated('base', REPORTED)} SELECT t::DOUBLE AS threshold, (SELECT count(*) FROM q WHERE q.q <= t::DOUBLE) AS n FROM (VALUES (0.5), (0.6), (0.7), (0.8)) v(t)",
    "fdr_accepted_targets": f"WITH {ROWS}, {winners('base')}, {rated('base', TRAINING)} SELECT base, score FROM q WHERE NOT decoy AND q <= 0.6",
    "fdr_best_per_peptide": f"WITH {ROWS} SELECT peptide, base, line, score, decoy FROM (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY score DESC, base, line) AS n FROM r) WHERE n = 1",
    "fdr_compaction": f"WITH {ROWS}, {winners('run, base')}, {rated('base', REPORTED, 'run')} SELECT run, decoy, count(*) AS n, count(DISTINCT base) AS n_pairs FROM r WHERE base IN (SELECT base FROM q WHERE q <= 0.6) GROUP BY run, decoy",
    "fdr_effective_level": f"""WITH {ROWS}, {winners('run, base')}, {rated('base', REPORTED, 'run')},
      p AS (SELECT run, peptide AS base, decoy, score FROM r), {winners('run, base', 'p').replace('w AS', 'w2 AS')}, {rated('base', REPORTED, 'run', 'w2').replace('c AS', 'c2 AS').replace('q AS (', 'q2 AS (').replace('FROM c)', 'FROM c2)')}
      SELECT r.run, r.base, line, round(greatest(coalesce(q.q, 1.0), coalesce(q2.q, 1.0)), 9) AS q
      FROM r LEFT JOIN q ON r.run = q.run AND r.base = q.base AND r.decoy = q.decoy LEFT JOIN q2 ON r.run = q2.run AND r.peptide = q2.base AND r.decoy = q2.decoy""",
    "fdr_all_levels": f"""WITH {ROWS},
      {levelled('rp', 'r', 'run, base', 'run')},
      rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, peptide ORDER BY score DESC, line, base) AS n FROM r) WHERE n = 1), {levelled('rq', 'rb', 'run, base', 'run')},
      {levelled('ep', 'r', 'base', '')},
      eb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY score DESC, line, base) AS n FROM r) WHERE n = 1), {levelled('eq', 'eb', 'base', '')}
      SELECT r.run, r.base, r.line, r.peptide, round(coalesce(rp.q, 1), 9) AS run_precursor_q, round(coalesce(rq.q, 1), 9) AS run_peptide_q, round(coalesce(ep.q, 1), 9) AS exp_precursor_q, round(coalesce(eq.q, 1), 9) AS exp_peptide_q
      FROM r LEFT JOIN rp ON r.run = rp.run AND r.base = rp.base AND r.decoy = rp.decoy AND r.line = rp.line AND r.peptide = rp.peptide AND r.score = rp.score
      LEFT JOIN rq ON r.run = rq.run AND r.peptide = rq.peptide LEFT JOIN ep ON r.base = ep.base LEFT JOIN eq ON r.peptide = eq.peptide""",
    "fdr_picked_groups": f"""WITH {ROWS}, b AS (SELECT peptide, decoy, max(score) AS score, min(line / 10.0) AS best_q FROM r GROUP BY peptide, decoy),
      m AS (SELECT DISTINCT l_suppkey AS group_id, l_partkey AS peptide FROM lineitem),
      s AS (SELECT group_id, max(score) FILTER (NOT decoy AND best_q <= 0.1) AS t, max(score) FILTER (decoy) AS d FROM m JOIN b USING (peptide) GROUP BY group_id),
      w AS (SELECT group_id, CASE WHEN t IS NOT NULL AND coalesce(t >= d, true) THEN t ELSE d END AS score, NOT (t IS NOT NULL AND coalesce(t >= d, true)) AS decoy FROM s WHERE coalesce(t, d) IS NOT NULL),
      {rated('group_id', TRAINING)} SELECT group_id, decoy, score, round(q, 9) AS q FROM q""",
    "fdr_simple_by_quality": f"WITH u AS (SELECT doc_id, quality = 0 AS decoy, n_chars::DOUBLE AS score FROM documents JOIN labels USING (doc_id)), {rated('doc_id', TRAINING, rows='u')} SELECT doc_id, decoy, round(q, 9) AS q FROM q",
}
