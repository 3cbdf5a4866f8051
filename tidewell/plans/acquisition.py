"""Cycles, match scores, envelopes and double counts, over events, lines and parts."""

from __future__ import annotations

from math import factorial

from pyspark.sql import functions as F

from tidewell.functions import sequences as S
from tidewell.operators import acquisition as A
from tidewell.plans.text import ORACLE_SQL as TEXT_SQL
from tidewell.plans.text import parts
from tidewell.session import table


def cycles(spark, sf_dir):
    """Each user's events up to the first whole value that comes again."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("center"))
    return A.first_cycle(rows, ["user_id"], "event_id", "center")


def hyperscores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("b"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("y"), F.sum(F.log1p("l_extendedprice")).alias("s"))
    return rows.select("l_orderkey", F.round(A.hyperscore(F.col("b"), F.col("y"), F.col("s")), 6).alias("score"))


def envelopes(spark, sf_dir):
    rows = parts(spark, sf_dir).select("p_partkey", S.composition(F.col("seq")).alias("atoms"))
    return rows.select("p_partkey", F.posexplode(A.isotope_distribution(F.col("atoms"))).alias("k", "share")).withColumn("share", F.round("share", 9))


def deduplicated(spark, sf_dir):
    """Lines of an order whose parts are near and whose flags agree count once, by price."""
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    rows = lines.select("l_orderkey", name.alias("id"), F.col("l_quantity").cast("double").alias("at"), F.array("l_returnflag", "l_linestatus").alias("fragments"), "l_extendedprice").dropDuplicates(["l_orderkey", "id"])
    return A.without_double_counts(rows, ["l_orderkey"], "id", "at", "fragments", "l_extendedprice", 3.0).select("l_orderkey", "id")


def overlapping(spark, sf_dir):
    """Lines of an order count once if half of the places of the worse one's (part, supplier, price) are near one of the better one's."""
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    places = F.array((F.col("l_partkey") % 60).cast("double"), F.col("l_suppkey") % 40 + 0.25, F.col("l_linenumber") * 8 + 0.5)
    rows = lines.select("l_orderkey", name.alias("id"), F.col("l_quantity").cast("double").alias("at"), places.alias("fragments"), "l_extendedprice").dropDuplicates(["l_orderkey", "id"])
    return A.without_double_counts(rows, ["l_orderkey"], "id", "at", "fragments", "l_extendedprice", 10.0, tolerance=1.5, unit="absolute").select("l_orderkey", "id")


def _falling(n: str, k: int) -> str:
    return " * ".join(["1.0", *[f"({n} - {i})" for i in range(k)]])


def _shares(n: str, one: float, two: float = 0.0) -> str:
    """SQL list of the chances of 0 to 4 units of mass more: i atoms with one, j with two, of n."""
    rest, out = 1 - one - two, []
    for mass in range(5):
        ways = [(mass - 2 * j, j) for j in range(mass // 2 + 1) if two or not j]
        out.append(" + ".join(f"{_falling(n, i + j)} / {factorial(i) * factorial(j)} * {one**i * two**j!r} * pow({rest!r}, {n} - {i + j})" for i, j in ways))
    return f"[{', '.join(out)}]"


def _folded(a: str, b: str) -> str:
    return f"list_transform(range(0, 5), lambda i: list_sum(list_transform(range(0, i + 1), lambda j: {a}[j + 1] * {b}[i - j + 1])))"


QUERIES = {"cycle_first": cycles, "score_hyperscore": hyperscores, "isotope_envelopes": envelopes, "dedup_double_counts": deduplicated, "dedup_overlapping_fragments": overlapping}
ORACLE_SQL = {
    "cycle_first": """WITH m AS (SELECT user_id, event_id, floor(value)::BIGINT AS center, row_number() OVER (PARTITION BY user_id, floor(value) ORDER BY event_id) AS seen FROM events),
      a AS (SELECT user_id, min(event_id) FILTER (seen = 2) AS again FROM m GROUP BY 1)
      SELECT user_id, count(*) AS n_windows, min(center) AS least, max(center) AS most FROM m JOIN a USING (user_id) WHERE again IS NULL OR event_id < again GROUP BY 1""",
    "isotope_envelopes": f"""WITH a AS ({TEXT_SQL['sequence_composition']}),
      e AS (SELECT p_partkey, {', '.join(f'{_shares(x, p)} AS {x}' for x, p in A.HEAVY.items())}, {', '.join(f'{_shares(x, *p)} AS {x}' for x, p in A.HEAVY_TWO.items())} FROM a),
      f AS (SELECT *, {_folded('c', 'h')} AS ch FROM e), g AS (SELECT *, {_folded('ch', 'n')} AS chn FROM f), k AS (SELECT *, {_folded('chn', 'o')} AS chno FROM g), w AS (SELECT p_partkey, {_folded('chno', 's')} AS d FROM k)
      SELECT p_partkey, unnest(range(0, 5))::INT AS k, round(unnest(d) / list_sum(d), 9) AS share FROM w""",
    "dedup_double_counts": """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS id, l_quantity::DOUBLE AS place, l_returnflag AS f, l_linestatus AS s, l_extendedprice AS price FROM lineitem),
      n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY price DESC, id) AS nth FROM l),
      r AS (SELECT l_orderkey, 1::BIGINT AS nth, [struct_pack(id := id, place := place, f := f, s := s)] AS kept FROM n WHERE nth = 1
        UNION ALL SELECT n.l_orderkey, n.nth, CASE WHEN len(list_filter(r.kept, lambda k: abs(k.place - n.place) <= 3 AND (k.f = n.f OR k.f = n.s OR k.s = n.f OR k.s = n.s))) > 0 THEN r.kept ELSE list_append(r.kept, struct_pack(id := n.id, place := n.place, f := n.f, s := n.s)) END
        FROM r JOIN n ON r.l_orderkey = n.l_orderkey AND n.nth = r.nth + 1)
      SELECT l_orderkey, unnest(kept).id AS id FROM (SELECT l_orderkey, max_by(kept, nth) AS kept FROM r GROUP BY 1)""",
    "dedup_overlapping_fragments": """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS id, l_quantity::DOUBLE AS place, [(l_partkey % 60)::DOUBLE, l_suppkey % 40 + 0.25, l_linenumber * 8 + 0.5] AS f, l_extendedprice AS price FROM lineitem),
      n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY price DESC, id) AS nth FROM l),
      r AS (SELECT l_orderkey, 1::BIGINT AS nth, [struct_pack(id := id, place := place, f := f)] AS kept FROM n WHERE nth = 1
        UNION ALL SELECT n.l_orderkey, n.nth, CASE WHEN len(list_filter(r.kept, lambda k: abs(k.place - n.place) <= 10 AND len(list_filter(n.f, lambda x: len(list_filter(k.f, lambda y: abs(x - y) <= 1.5)) > 0)) >= 2)) > 0 THEN r.kept ELSE list_append(r.kept, struct_pack(id := n.id, place := n.place, f := n.f)) END
        FROM r JOIN n ON r.l_orderkey = n.l_orderkey AND n.nth = r.nth + 1)
      SELECT l_orderkey, unnest(kept).id AS id FROM (SELECT l_orderkey, max_by(kept, nth) AS kept FROM r GROUP BY 1)""",
    "score_hyperscore": "SELECT l_orderkey, round(lgamma(count(*) FILTER (l_returnflag = 'A') + 1) + lgamma(count(*) FILTER (l_returnflag = 'R') + 1) + sum(ln(1 + l_extendedprice)), 6) AS score FROM lineitem GROUP BY 1",
}
