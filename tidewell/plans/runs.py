"""Reconciliation of runs, calibration before the search, and stride samples, over lines, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import calibration, reconcile, stats, survey
from tidewell.plans.kernels import event_matrix
from tidewell.session import table
from tidewell.storage import stored


def detections(spark, sf_dir):
    """Return flags as runs, parts as peptides, lines of a part as its peaks: the dearest is the one detected, the others are stored with it."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_returnflag").alias("file_name"), F.col("l_partkey").alias("peptide"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("charge"), (F.col("l_suppkey") % 2 == 1).alias("decoy"), F.col("l_quantity").cast("double").alias("q"), "l_extendedprice", "l_discount", "l_tax", "l_orderkey")
    peak = F.struct(F.col("q").alias("apex"), (F.col("q") - 0.5).alias("start"), (F.col("q") + 0.75).alias("end"))
    best = F.max_by("q", F.struct("l_extendedprice", "q", "l_orderkey"))
    found = rows.groupBy("file_name", "peptide", "charge", "decoy").agg(
        best.alias("apex"), F.array_sort(F.collect_set(peak)).alias("candidates"), F.min("l_discount").alias("run_precursor_q"), F.min("l_tax").alias("run_peptide_q"), F.max("l_discount").alias("exp_precursor_q"), F.max("l_tax").alias("exp_peptide_q"), (F.max("l_extendedprice") / 30000 - 1).alias("score"), F.count("*").cast("double").alias("coelution")
    )
    entry = F.col("peptide") * 8 + F.col("charge") * 2 + F.col("decoy").cast("int")
    return found.select("*", (F.col("apex") - 0.5).alias("start"), (F.col("apex") + 0.75).alias("end"), F.lit(1.0).alias("run_protein_q"), entry.alias("entry_id"))


def reconciled(spark, sf_dir):
    """Accepted parts in all three runs, whose time scales are lines."""
    rows = stored(detections(spark, sf_dir), "detections")
    curves = spark.createDataFrame([(f, [0.0, 60.0], [b, b + 60 * a], 2.0) for f, (a, b) in SCALES.items()], "file_name string, knots array<double>, fitted array<double>, mad double")
    windows = spark.createDataFrame(WINDOWS, "file_name string, low double, high double")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("peptide"), (400.0 + F.col("p_partkey") % 100).alias("precursor_mz"))
    each = parts.select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("charge")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("decoy"))
    library = each.withColumn("entry_id", F.col("peptide") * 8 + F.col("charge") * 2 + F.col("decoy").cast("int"))
    found = reconcile.reconcile(rows, curves, library, windows, threshold=0.03, refit=False)
    return found.select("file_name", "entry_id", "action", *[F.round(c, 5).alias(c) for c in ("apex", "start", "end")])


def stride(spark, sf_dir):
    """A tenth of the orders, spread over date and price."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1990-01-01")).alias("day"), "o_totalprice")
    return stats.stride_sample(rows, "day", "o_totalprice", "o_orderkey", rows.count() // 10, 43).select("o_orderkey")


def calibrated(spark, sf_dir):
    """Attempts to calibrate three runs, each a third of the events, by users as entries whose times are on another scale."""
    slots = event_matrix(spark, sf_dir).withColumn("mz", F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(9000)) / 10.0 + 100)
    runs = slots.withColumn("file_name", F.explode(F.array(F.lit("all"), F.concat(F.lit("part "), F.pmod("slot", F.lit(2)).cast("string")))))
    center = 400.0 + F.col("user_id")
    peaks_of = F.array_sort(F.collect_list(F.struct("mz", F.col("value").alias("y"))))
    scans = runs.groupBy("file_name", "user_id", "slot").agg(peaks_of.alias("p")).select(
        "file_name", F.col("slot").alias("scan"), F.col("slot").cast("double").alias("rt"), (center - 0.4).alias("iso_low"), (center + 0.4).alias("iso_high"), F.col("p.mz").alias("mzs"), F.col("p.y").alias("intensities")
    )
    by_type = slots.groupBy("user_id", "mz").agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("slot")).alias("moment"))
    fragments = F.array_sort(F.collect_list(F.struct("mz", F.col("total").alias("intensity"))))
    entries = by_type.groupBy("user_id").agg(fragments.alias("fragments"), (F.sum("moment") / F.sum("total") * 3 + 10).alias("rt"))
    both = entries.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("decoy"))
    shifted = F.transform("fragments", lambda f, i: F.struct((f.mz + F.when(F.col("decoy") & (i > 0), 0.9).otherwise(0.0)).alias("mz"), f.intensity.alias("intensity")))
    both = both.select((F.col("user_id") * 2 + F.col("decoy").cast("int")).alias("entry_id"), F.col("user_id").alias("base"), (400.0 + F.col("user_id")).alias("precursor_mz"), "rt", shifted.alias("fragments"), "decoy")
    settings = calibration.Settings(sample=max(10, entries.count() // 4), enough=30, fewest=20, threshold=0.2, least_snr=1.0, narrowest=2.0, widest=40.0, ppm=20.0)
    return calibration.calibrate(both, scans, settings).attempts.select("file_name", "attempt", "sampled", "matched", "passing", "state", F.round("searched", 4).alias("searched"), F.round("tolerance", 4).alias("tolerance"), "refined")


def survey_features(spark, sf_dir):
    """Return flags as runs, lines of a part as its profile over days, all lines of a week as a survey scan of parts by quantity."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file_name"), F.col("l_partkey").alias("entry_id"), day.alias("day"), "l_extendedprice", F.col("l_quantity").cast("double").alias("y"))
    mass = lambda part: 400.0 + part % 997 * 0.01
    points = lines.select("file_name", "entry_id", "day", "l_extendedprice").repartition("file_name", "entry_id").groupBy("file_name", "entry_id", "day").agg(F.sum("l_extendedprice").alias("height"))
    profile = F.array_sort(F.collect_list(F.struct(F.col("day").cast("double").alias("rt"), F.col("height").cast("double").alias("y"))))
    apex = F.min(F.struct((-F.col("height")).alias("h"), F.col("day").alias("d"))).d.cast("double")
    found = points.groupBy("file_name", "entry_id").agg(apex.alias("apex_rt"), profile.alias("p")).select("file_name", "entry_id", "apex_rt", F.col("p.rt").alias("profile_rt"), F.col("p.y").alias("profile"))
    week = F.floor(F.col("day") / 7)
    surveys = lines.select("file_name", week.alias("scan"), (week * 7).cast("double").alias("rt"), mass(F.col("entry_id")).alias("at"), "y")
    share = F.col("p_size") / 50.0
    isotopes = F.array(F.lit(1.0), share, share * share, share * share * share, F.lit(0.0))
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), mass(F.col("p_partkey")).alias("precursor_mz"), (F.col("p_size") % 3 + 1).alias("charge"), isotopes.alias("isotopes"))
    out = survey.with_survey_features(stored(found, "matches"), entries, surveys, 20.0)
    return out.select("file_name", "entry_id", "apex_rt", F.round("survey_coelution", 6).alias("survey_coelution"), F.round("survey_isotopes", 6).alias("survey_isotopes"))


#: Slope and intercept of each run's times, and its isolation windows.
SCALES = {"A": (1.0, 1.0), "N": (1.1, 0.0), "R": (0.9, 2.0)}
WINDOWS = [("A", 400.0, 480.0), ("N", 420.0, 460.0), ("N", 455.0, 500.0), ("R", 400.0, 450.0), ("R", 450.0, 470.0)]
_S = "(VALUES " + ", ".join(f"('{f}', {a}::DOUBLE, {b}::DOUBLE)" for f, (a, b) in SCALES.items()) + ") s(file_name, a, b)"
_W = "(VALUES " + ", ".join(f"('{f}', {a}::DOUBLE, {b}::DOUBLE)" for f, a, b in WINDOWS) + ") w(file_name, low, high)"
_COVER = reconcile.MAD_SD * reconcile.COVER
QUERIES = {"reconcile_runs": reconciled, "stats_stride_sample": stride, "calibration_attempts": calibrated, "survey_features": survey_features}
ORACLE_SQL = {
    "reconcile_runs": f"""WITH d AS (SELECT l_returnflag AS file_name, l_partkey AS peptide, l_linenumber % 3 + 1 AS charge, l_suppkey % 2 = 1 AS decoy, arg_max(l_quantity::DOUBLE, (l_extendedprice, l_quantity, l_orderkey)) AS apex,
        list_sort(list(DISTINCT l_quantity::DOUBLE)) AS others, min(l_discount) AS rq, min(l_tax) AS tq, max(l_discount) AS eq, max(l_tax) AS uq, greatest(1 / (1 + exp(-(max(l_extendedprice) / 30000 - 1))), 1e-6) AS w FROM lineitem GROUP BY ALL),
      good AS (SELECT *, NOT decoy AND rq <= 0.03 AND tq <= 0.03 AS ok FROM d),
      m AS (SELECT peptide, decoy, file_name, w, (apex - b) / a AS rt FROM good JOIN {_S} USING (file_name) WHERE (ok OR decoy) AND peptide IN (SELECT peptide FROM good WHERE ok)),
      r AS (SELECT *, sum(w) OVER (PARTITION BY peptide, decoy ORDER BY rt) AS upto, sum(w) OVER (PARTITION BY peptide, decoy) AS whole FROM m),
      c AS (SELECT peptide, decoy, min(rt) AS rt FROM r WHERE upto * 2 >= whole GROUP BY 1, 2),
      k AS (SELECT peptide, decoy, any_value(c.rt) AS rt, CASE WHEN count(DISTINCT file_name) >= 3 THEN median(abs(m.rt - c.rt)) END AS mad FROM m JOIN c USING (peptide, decoy) GROUP BY 1, 2),
      own AS (SELECT greatest(coalesce(median(mad), 0.05) * {_COVER}, 0.1) AS own FROM k WHERE NOT decoy),
      p AS (SELECT file_name, abs(apex - (a * k.rt + b)) AS off FROM d JOIN k USING (peptide, decoy) JOIN {_S} USING (file_name) WHERE NOT decoy AND greatest(eq, uq) <= 0.03),
      o AS (SELECT *, median(off) OVER (PARTITION BY file_name) * {_COVER} AS clip FROM p),
      u AS (SELECT file_name, off FROM (SELECT *, count(*) FILTER (off <= clip) OVER (PARTITION BY file_name) AS n FROM o) WHERE n < 20 OR off <= clip),
      t AS (SELECT s.file_name, least(own, greatest(2.0 * {_COVER}, 0.1), coalesce(greatest(x.mad * {_COVER}, 0.1), 1e9)) AS tol FROM {_S} LEFT JOIN (SELECT file_name, list_sort(list(off))[len(list(off)) // 2 + 1] AS mad FROM u GROUP BY 1) x USING (file_name), own),
      i AS (SELECT DISTINCT peptide, charge FROM d WHERE NOT decoy AND least(rq, tq, eq, uq) <= 0.03),
      e AS (SELECT d.file_name, d.peptide * 8 + d.charge * 2 + d.decoy::INT AS entry_id, apex, others, a * k.rt + b AS x, tol FROM d JOIN i USING (peptide, charge) JOIN k USING (peptide, decoy) JOIN t USING (file_name) JOIN {_S} USING (file_name)),
      n AS (SELECT *, list_sort(list_transform(list_filter(others, lambda v: abs(v - x) <= tol), lambda v: struct_pack(off := round(abs(v - x), 9), v := v)))[1].v AS near FROM e),
      g AS (SELECT w.file_name, i.peptide, i.charge FROM i JOIN (SELECT DISTINCT file_name, low, high FROM {_W}) w ON 400.0 + i.peptide % 100 >= low AND 400.0 + i.peptide % 100 < high GROUP BY ALL)
      SELECT file_name, entry_id, CASE WHEN abs(apex - x) <= tol THEN 'keep' WHEN near IS NOT NULL THEN 'move' ELSE 'force' END AS action, round(CASE WHEN abs(apex - x) <= tol THEN apex ELSE coalesce(near, x) END, 5) AS apex,
        round(CASE WHEN abs(apex - x) <= tol THEN apex - 0.5 WHEN near IS NOT NULL THEN near - 0.5 ELSE x - 0.625 END, 5) AS "start", round(CASE WHEN abs(apex - x) <= tol THEN apex + 0.75 WHEN near IS NOT NULL THEN near + 0.75 ELSE x + 0.625 END, 5) AS "end" FROM n
      UNION ALL SELECT g.file_name, g.peptide * 8 + g.charge * 2 + z.decoy, 'fill', round(a * k.rt + b, 5), round(a * k.rt + b - 0.625, 5), round(a * k.rt + b + 0.625, 5)
        FROM g ANTI JOIN (SELECT * FROM d WHERE NOT decoy) d ON g.file_name = d.file_name AND g.peptide = d.peptide AND g.charge = d.charge JOIN k ON k.peptide = g.peptide AND NOT k.decoy JOIN {_S} ON s.file_name = g.file_name, (VALUES (0), (1)) z(decoy)""",
    "survey_features": """WITH l AS (SELECT l_returnflag AS file_name, l_partkey AS entry_id, datediff('day', DATE '1992-01-01', l_shipdate::DATE) AS day, l_extendedprice AS price, l_quantity::DOUBLE AS q FROM lineitem),
      p AS (SELECT file_name, entry_id, day, sum(price) AS h FROM l GROUP BY ALL),
      a AS (SELECT file_name, entry_id, arg_min(day, (-h, day)) AS day FROM p GROUP BY 1, 2),
      n AS (SELECT file_name, day, arg_min(w, (abs(w * 7 - day), w)) AS w FROM (SELECT DISTINCT file_name, day FROM l) JOIN (SELECT DISTINCT file_name, day // 7 AS w FROM l) USING (file_name) GROUP BY 1, 2),
      k AS (SELECT file_name, day // 7 AS w, 400.0::DOUBLE + entry_id % 997 * 0.01::DOUBLE AS m, max(q) AS y FROM l GROUP BY ALL),
      d AS (SELECT p_partkey AS entry_id, 400.0::DOUBLE + p_partkey % 997 * 0.01::DOUBLE AS mz, p_size % 3 + 1 AS c, p_size / 50.0::DOUBLE AS s FROM part),
      e AS (SELECT p.file_name, p.entry_id, p.day, h, coalesce(max(y), 0) AS y FROM p JOIN n USING (file_name, day) JOIN d USING (entry_id) LEFT JOIN k ON k.file_name = p.file_name AND k.w = n.w AND abs(m - mz) <= mz * 20 / 1e6 GROUP BY ALL),
      f AS (SELECT file_name, entry_id, CASE WHEN count(*) >= 3 AND max(y) > min(y) AND max(h) > min(h) THEN covar_pop(y, h) / (stddev_pop(y) * stddev_pop(h)) ELSE 0 END AS co FROM e GROUP BY 1, 2),
      o AS (SELECT a.file_name, a.entry_id, i, s, coalesce(max(y), 0) AS y FROM a JOIN n USING (file_name, day) JOIN d USING (entry_id), (SELECT unnest(range(-1, 4)) AS i) LEFT JOIN k ON k.file_name = a.file_name AND k.w = n.w AND abs(m - (mz + i * 1.002868::DOUBLE / c)) <= (mz + i * 1.002868::DOUBLE / c) * 20 / 1e6 GROUP BY ALL),
      v AS (SELECT file_name, entry_id, CASE WHEN max(y) FILTER (i = 0) > 0 THEN sum(CASE WHEN i >= 0 THEN y * s ** i ELSE 0 END) / sqrt(sum(y * y) * sum(CASE WHEN i >= 0 THEN s ** (2 * i) ELSE 0 END)) ELSE 0 END AS iso FROM o GROUP BY 1, 2)
      SELECT a.file_name, a.entry_id, a.day::DOUBLE AS apex_rt, round(co, 6) AS survey_coelution, round(iso, 6) AS survey_isotopes FROM a JOIN f USING (file_name, entry_id) JOIN v USING (file_name, entry_id)""",
    "stats_stride_sample": """WITH o AS (SELECT o_orderkey, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS x, o_totalprice AS y FROM orders),
      z AS (SELECT count(*) // 10 AS size, greatest(5, ceil(sqrt(count(*) // 10) / 2)) AS bins, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM o),
      c AS (SELECT o_orderkey, size, least(floor((x - x0) / (greatest(x1 - x0, 1e-6) / bins)), bins - 1) AS cx, least(floor((y - y0) / (greatest(y1 - y0, 1e-6) / bins)), bins - 1) AS cy FROM o, z),
      n AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY cx, cy) AS n, (SELECT count(*) FROM (SELECT DISTINCT cx, cy FROM c)) AS cells FROM c),
      s AS (SELECT *, least(n, greatest(size // cells, 1)) AS share FROM n),
      t AS (SELECT *, n // share AS stride, (i - 43 % n + n) % n AS step FROM s),
      u AS (SELECT *, CASE WHEN step % stride = 0 AND step // stride < share THEN step // stride END AS turn FROM t),
      v AS (SELECT *, count(*) FILTER (turn IS NULL) OVER (PARTITION BY cx, cy ORDER BY i) AS later FROM u),
      r AS (SELECT o_orderkey, size, row_number() OVER (ORDER BY turn IS NULL, coalesce(turn, later), cx, cy) AS k FROM v)
      SELECT o_orderkey FROM r WHERE k <= size""",
}
