"""Notation and sequence functions over part names as residue strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import sequences as S
from tidewell.operators import features
from tidewell.session import table


def parts(spark, sf_dir):
    """A residue string for each part, from its name, and notation around it."""
    p = table(spark, sf_dir, "part")
    letters = F.translate(F.upper("p_name"), "BJOUXZ ", "DKNVGS")
    return p.select("p_partkey", letters.alias("seq"), F.concat(F.lit("K."), letters, F.lit("[UNIMOD:35](Oxidation)_.R")).alias("noted"), F.concat("p_type", F.lit("; ,"), "p_brand", F.lit(",")).alias("listed"))


def decoys(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", S.reversed_inner(F.col("seq")).alias("last"), S.reversed_inner(F.col("seq"), "first").alias("first"), S.rotated_inner(F.col("seq"), 3).alias("turned"))


def notation(spark, sf_dir):
    bare = S.strip_flanks(F.col("noted"))
    return parts(spark, sf_dir).select("p_partkey", bare.alias("bare"), S.strip_modifications(bare).alias("plain"), S.mass_notation(bare).alias("masses"), F.array_join(S.unimod_ids(F.col("noted")), ",").alias("ids"))


def lists(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", F.array_join(S.split_list(F.col("listed")), "|").alias("parts"))


def composed(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", S.composition(F.col("seq")).alias("x"), F.round(S.mass(F.col("seq")), 6).alias("mass"), F.round(S.precursor_mz(F.col("seq"), F.lit(2)), 7).alias("mz")).select("p_partkey", "x.c", "x.h", "x.n", "x.o", "x.s", "mass", "mz")


def fragments(spark, sf_dir):
    rows = parts(spark, sf_dir).select("p_partkey", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 1)).alias("k"))
    one = F.lit(1)
    return rows.select("p_partkey", F.col("k").cast("long").alias("k"), F.round(S.fragment_mz(F.col("seq"), "b", F.col("k"), one), 6).alias("b"), F.round(S.fragment_mz(F.col("seq"), "y", F.col("k"), one, F.lit(S.WATER)), 6).alias("y"))


def unique_decoys(spark, sf_dir):
    """Reversed sequences that no target has; where one does, the first turn of up to ten places that is free, or neither."""
    targets = parts(spark, sf_dir).select("seq").distinct()
    tries = F.array(F.struct(F.lit(0).alias("turn"), S.reversed_inner(F.col("seq")).alias("decoy")), *[F.struct(F.lit(k).alias("turn"), S.rotated_inner(F.col("seq"), k).alias("decoy")) for k in range(1, 11)])
    each = targets.select("seq", F.inline(tries)).filter((F.col("turn") < F.length("seq")) & (F.col("decoy") != F.col("seq")))
    free = each.join(targets.withColumnRenamed("seq", "decoy"), "decoy", "left_anti")
    return free.groupBy("seq").agg(F.min_by("decoy", "turn").alias("decoy"), F.min("turn").alias("turn"))


SEQ = "p AS (SELECT p_partkey, p_type, p_brand, translate(upper(p_name), 'BJOUXZ ', 'DKNVGS') AS seq FROM part)"


def sums(table: dict, value=lambda v: v) -> str:
    return " + ".join(f"{value(v)} * (length(seq) - length(replace(seq, '{k}', '')))" for k, v in table.items())


def mass_of(part: str) -> str:
    return " + ".join(f"{v} * (length({part}) - length(replace({part}, '{k}', '')))" for k, v in S.RESIDUE_MASS.items())


def masses(spark, sf_dir):
    """Modifications of a noted sequence as rows, positions from 1: a signed mass at its third residue, a bare one at its end, a name that is none."""
    noted = F.concat(F.lit("_"), F.substring("seq", 1, 3), F.lit("[+"), F.col("p_partkey") % 90 + 0.5, F.lit("]"), F.expr("substring(seq, 4)"), F.lit("(-17.25)[Oxidation]_"))
    rows = parts(spark, sf_dir).select("p_partkey", F.inline(S.bracketed_masses(noted)))
    return rows.select("p_partkey", (F.col("position") + 1).cast("long").alias("position"), "mass")


def covered(spark, sf_dir):
    """Cleavage sites of a part's sequence that its lines cover, and the rank of its largest line among the dearest."""
    lines = table(spark, sf_dir, "lineitem")
    ion = F.when(F.col("l_returnflag") == "R", "b").when(F.col("l_returnflag") == "A", "y").otherwise("c")
    match = F.struct((F.col("l_quantity") % 13).cast("int").alias("ordinal"), ion.alias("ion"))
    peak = F.struct("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("expected"), F.col("l_quantity").alias("observed"))
    by_part = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(match).alias("matches"), F.array_sort(F.collect_list(peak)).alias("peaks"))
    rows = parts(spark, sf_dir).join(by_part, "p_partkey")
    return rows.select("p_partkey", F.round(features.cleavage_coverage(F.length("seq"), F.col("matches")), 9).alias("coverage"), features.base_peak_rank(F.col("peaks")).cast("long").alias("rank"))


TURN = "CASE WHEN length(seq) < 2 THEN seq ELSE substr(seq, {0} % greatest(length(seq) - 1, 1) + 1, length(seq) - 1 - {0} % greatest(length(seq) - 1, 1)) || substr(seq, 1, {0} % greatest(length(seq) - 1, 1)) || right(seq, 1) END"
BACK = "CASE WHEN length(seq) < 2 THEN seq ELSE reverse(substr(seq, 1, length(seq) - 1)) || right(seq, 1) END"
QUERIES = {
    "sequence_decoys": decoys,
    "sequence_notation": notation,
    "sequence_split_list": lists,
    "sequence_composition": composed,
    "sequence_fragments": fragments,
    "sequence_unique_decoys": unique_decoys,
    "sequence_bracketed_masses": masses,
    "sequence_coverage": covered,
}
ORACLE_SQL = {
    "sequence_decoys": f"WITH {SEQ} SELECT p_partkey, {BACK} AS last, left(seq, 1) || reverse(substr(seq, 2)) AS first, {TURN.format(3)} AS turned FROM p",
    "sequence_notation": f"WITH {SEQ} SELECT p_partkey, seq || '[UNIMOD:35](Oxidation)_' AS bare, seq AS plain, seq || '[+15.9949](Oxidation)_' AS masses, '35' AS ids FROM p",
    "sequence_split_list": "SELECT p_partkey, p_type || '|' || p_brand AS parts FROM part",
    "sequence_composition": f"WITH {SEQ}, m AS (SELECT *, {S.WATER} + {sums(S.RESIDUE_MASS)} AS mass FROM p) SELECT p_partkey, {', '.join(f'({sums(S.RESIDUE_ATOMS, lambda v, i=i: v[i])} + {e})::INT AS {k}' for i, (k, e) in enumerate(zip('chnos', (0, 2, 0, 1, 0), strict=True)))}, round(mass, 6) AS mass, round((mass + 2 * {S.PROTON}) / 2, 7) AS mz FROM m",
    "sequence_fragments": f"WITH {SEQ}, f AS (SELECT p_partkey, k, substr(seq, 1, k) AS b, substr(seq, length(seq) - k + 1) AS y FROM (SELECT *, unnest(generate_series(1, length(seq) - 1)) AS k FROM p)) SELECT p_partkey, k, round({mass_of('b')} + {S.PROTON}, 6) AS b, round({mass_of('y')} + {S.PROTON}, 6) AS y FROM f",
    "sequence_bracketed_masses": f"WITH {SEQ} SELECT p_partkey, 3 AS position, p_partkey % 90 + 0.5::DOUBLE AS mass FROM p UNION ALL SELECT p_partkey, length(seq), -17.25 FROM p",
    "sequence_coverage": f"""WITH {SEQ}, m AS (SELECT DISTINCT l_partkey AS p_partkey, CASE l_returnflag WHEN 'R' THEN k WHEN 'A' THEN n - k END AS site, n FROM (SELECT *, (l_quantity % 13)::INT AS k, length(seq) AS n FROM lineitem JOIN p ON p_partkey = l_partkey) WHERE k > 0 AND k < n),
      c AS (SELECT p_partkey, count(site) / (any_value(n) - 1) AS coverage FROM m GROUP BY 1),
      t AS (SELECT l_partkey, l_extendedprice AS e FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1),
      r AS (SELECT t.l_partkey AS p_partkey, count(*) FILTER (l.l_extendedprice > e) + 1 AS rank FROM t JOIN lineitem l ON l.l_partkey = t.l_partkey GROUP BY 1)
      SELECT p_partkey, round(coalesce(coverage, 0.0), 9) AS coverage, rank FROM r LEFT JOIN c USING (p_partkey) WHERE p_partkey IN (SELECT p_partkey FROM p)""",
    "sequence_unique_decoys": f"""WITH {SEQ}, t AS (SELECT DISTINCT seq FROM p), a AS (SELECT seq, 0 AS turn, {BACK} AS decoy FROM t UNION ALL SELECT seq, k, {TURN.format('k')} FROM t, unnest(generate_series(1, 10)) g(k))
      SELECT seq, arg_min(decoy, turn) AS decoy, min(turn)::INT AS turn FROM a WHERE turn < length(seq) AND decoy <> seq AND decoy NOT IN (SELECT seq FROM t) GROUP BY seq""",
}
