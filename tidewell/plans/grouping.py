"""Parsimony: orders as owners and parts as members; components over shared parts. All lines count."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import grouping
from tidewell.operators.components import connected_components
from tidewell.session import table


def edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("member")).distinct()


def groups(spark, sf_dir):
    return grouping.identical_sets(edges(spark, sf_dir), "owner", "member")


def identical(spark, sf_dir):
    return groups(spark, sf_dir).select("group_id", F.size("owners").cast("long").alias("n_owners"), F.array_join("members", ",").alias("members"))


def reduced(spark, sf_dir):
    return grouping.without_subsets(groups(spark, sf_dir)).select("group_id", F.array_join("members", ",").alias("members"))


def split(spark, sf_dir):
    return grouping.split_members(grouping.without_subsets(groups(spark, sf_dir)))


def razor(spark, sf_dir):
    out = grouping.razor(grouping.without_subsets(groups(spark, sf_dir)))
    return out.select("group_id", F.array_join("members", ",").alias("members"))


def unique(spark, sf_dir):
    out = grouping.without_shared(grouping.without_subsets(groups(spark, sf_dir)))
    return out.select("group_id", F.array_join("members", ",").alias("members"))


def components(spark, sf_dir):
    """Orders and parts that lines connect."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    return connected_components(lines)


SETS = """e AS (SELECT DISTINCT l_orderkey AS owner, l_partkey AS member FROM lineitem),
  s AS (SELECT owner, list_sort(list(member)) AS m FROM e GROUP BY owner), g AS (SELECT min(owner) AS group_id, count(*) AS n_owners, m FROM s GROUP BY m)"""
KEPT = """a AS (SELECT group_id, len(m) AS n, unnest(m) AS member FROM g),
  i AS (SELECT a.group_id FROM a JOIN a b ON a.member = b.member AND b.n > a.n GROUP BY a.group_id, a.n, b.group_id HAVING count(*) = a.n),
  k AS (SELECT group_id, m FROM g WHERE group_id NOT IN (SELECT group_id FROM i)),
  x AS (SELECT group_id, unnest(m) AS member FROM k), d AS (SELECT member, count(*) AS n FROM x GROUP BY 1)"""
QUERIES = {
    "grouping_identical_sets": identical,
    "grouping_without_subsets": reduced,
    "grouping_unique_and_shared": split,
    "grouping_razor": razor,
    "grouping_unique_only": unique,
    "grouping_components": components,
}
ORACLE_SQL = {
    "grouping_identical_sets": f"WITH {SETS} SELECT group_id, n_owners, array_to_string(m, ',') AS members FROM g",
    "grouping_without_subsets": f"WITH {SETS}, {KEPT} SELECT group_id, array_to_string(m, ',') AS members FROM k",
    "grouping_unique_and_shared": f"WITH {SETS}, {KEPT} SELECT group_id, count(*) FILTER (n = 1) AS n_unique, count(*) FILTER (n > 1) AS n_shared FROM x JOIN d USING (member) GROUP BY 1",
    "grouping_razor": f"""WITH {SETS}, {KEPT}, u AS (SELECT group_id, count(*) FILTER (n = 1) AS own FROM x JOIN d USING (member) GROUP BY 1),
      t AS (SELECT member, group_id, row_number() OVER (PARTITION BY member ORDER BY own DESC, group_id) AS nth FROM x JOIN u USING (group_id)),
      l AS (SELECT group_id, array_to_string(list_sort(list(member)), ',') AS members FROM t WHERE nth = 1 GROUP BY 1)
      SELECT group_id, coalesce(members, '') AS members FROM k LEFT JOIN l USING (group_id)""",
    "grouping_unique_only": f"""WITH {SETS}, {KEPT}, l AS (SELECT group_id, array_to_string(list_sort(list(member)), ',') AS members FROM x JOIN d USING (member) WHERE n = 1 GROUP BY 1)
      SELECT group_id, coalesce(members, '') AS members FROM k LEFT JOIN l USING (group_id)""",
    # label propagation: each turn gives a node the least label around it
    "grouping_components": """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem),
      u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      r AS (SELECT DISTINCT 0 AS turn, a AS node, a AS root FROM u
            UNION ALL SELECT turn + 1, node, min(root) FROM (SELECT r.turn, r.node, r.root FROM r UNION ALL SELECT r.turn, u.b, r.root FROM r JOIN u ON r.node = u.a) WHERE turn < 25 GROUP BY turn, node)
      SELECT node, root FROM r WHERE turn = 25""",
}
