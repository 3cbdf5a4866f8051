"""Array functions over embeddings: similarities, correlations, matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import arrays as A
from tidewell.session import table


def paired(spark, sf_dir):
    """Each vector beside the next one of its label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("other"))
    return e.join(first, "label").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), F.col("other").cast("array<double>").alias("b"))


def _one(name, column):
    def run(spark, sf_dir):
        return paired(spark, sf_dir).select("vec_id", F.round(column(), 5).alias(name))

    return run


def _positive(v: str):
    return F.transform(v, lambda x: F.abs(x))


def top(spark, sf_dir):
    return paired(spark, sf_dir).select("vec_id", F.array_join(A.top_indices(F.col("a"), 6), ",").alias("top"))


def matches(spark, sf_dir):
    got = A.matched(F.col("a"), F.col("b"), 0.001, "absolute")
    six = A.has_top_match(F.col("a"), F.col("a"), F.col("b"), 0.02, "absolute", least=3)
    return paired(spark, sf_dir).select("vec_id", F.size(got).cast("long").alias("n_matched"), six.alias("enough"))


def closest(spark, sf_dir):
    errors = A.closest_error(F.col("a"), F.col("b"), 0.01, "absolute")
    return paired(spark, sf_dir).select("vec_id", F.size(errors).cast("long").alias("n"), F.round(A.total(F.transform(errors, lambda x: F.abs(x))), 5).alias("error"))


def smoothed(spark, sf_dir):
    s = A.savitzky_golay(_positive("a"))
    return paired(spark, sf_dir).select("vec_id", F.round(A.total(s), 4).alias("total"), F.round(F.array_max(s), 5).alias("largest"))


def longest(spark, sf_dir):
    above = F.filter(F.transform("a", lambda x, i: F.when(x > 0, i)), lambda x: x.isNotNull())
    return paired(spark, sf_dir).select("vec_id", A.longest_run(above).cast("long").alias("run"))


def best_matches(spark, sf_dir):
    """For each label's first vector, the ten most similar vectors of all: a stated query set against all rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    queries = e.groupBy("label").agg(F.min("vec_id").alias("query"), F.min_by("v", "vec_id").alias("q")).drop("label")
    scored = e.drop("label").crossJoin(F.broadcast(queries)).filter("vec_id <> query").select("query", "vec_id", F.round(A.cosine(F.col("v"), F.col("q")), 5).alias("score"))
    from tidewell.operators.dedup import top_rows

    return top_rows(scored.filter("score > 0"), ["query"], 10, F.col("score").desc(), "vec_id").select("query", "vec_id", "score")


PAIR = "p AS (SELECT vec_id, a::DOUBLE[] AS a, b::DOUBLE[] AS b FROM (SELECT vec_id, label, embedding AS a FROM embeddings) JOIN (SELECT label, arg_min(embedding, vec_id) AS b FROM embeddings GROUP BY label) USING (label))"
LONG = f"WITH {PAIR}, l AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, unnest(range(len(a))) AS i FROM p)"


def cos(x: str, y: str) -> str:
    return f"least(1.0, greatest(0.0, sum({x} * {y}) / sqrt(sum({x} * {x}) * sum({y} * {y}))))"


RANKED = "rank() OVER (PARTITION BY vec_id ORDER BY {0}) + (count(*) OVER (PARTITION BY vec_id, {0}) - 1) / 2.0"

QUERIES = {
    "array_cosine": _one("cosine", lambda: A.cosine(F.col("a"), F.col("b"))),
    "array_root_cosine": _one("cosine", lambda: A.root_cosine(_positive("a"), _positive("b"))),
    "array_weighted_root_cosine": _one("cosine", lambda: A.weighted_root_cosine(_positive("a"), _positive("b"), F.transform("a", lambda x, i: i + 1.0))),
    "array_pearson": _one("r", lambda: A.pearson(F.col("a"), F.col("b"))),
    "array_spearman": _one("r", lambda: A.spearman(F.col("a"), F.col("b"))),
    "array_top_indices": top,
    "array_matches": matches,
    "array_closest_error": closest,
    "array_smoothing": smoothed,
    "array_longest_run": longest,
    "array_best_matches": best_matches,
}
ORACLE_SQL = {
    "array_cosine": f"{LONG} SELECT vec_id, round({cos('x', 'y')}, 5) AS cosine FROM l GROUP BY 1",
    "array_root_cosine": f"{LONG} SELECT vec_id, round({cos('sqrt(abs(x))', 'sqrt(abs(y))')}, 5) AS cosine FROM l GROUP BY 1",
    "array_weighted_root_cosine": f"{LONG} SELECT vec_id, round({cos('(sqrt(abs(x)) * (i + 1) * (i + 1))', '(sqrt(abs(y)) * (i + 1) * (i + 1))')}, 5) AS cosine FROM l GROUP BY 1",
    "array_pearson": f"{LONG} SELECT vec_id, round(corr(x, y), 5) AS r FROM l GROUP BY 1",
    "array_spearman": f"{LONG}, r AS (SELECT vec_id, {RANKED.format('x')} AS x, {RANKED.format('y')} AS y FROM l) SELECT vec_id, round(corr(x, y), 5) AS r FROM r GROUP BY 1",
    "array_top_indices": f"{LONG}, r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS k FROM l) SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY k) AS top FROM r WHERE k <= 6 GROUP BY 1",
    "array_matches": f"""WITH {PAIR} SELECT vec_id, len(list_filter(a, lambda x: len(list_filter(b, lambda y: abs(y - x) <= 0.001)) > 0)) AS n_matched,
      len(list_filter(list_sort(a, 'DESC')[1:6], lambda x: len(list_filter(b, lambda y: abs(y - x) <= 0.02)) > 0)) >= 3 AS enough FROM p""",
    "array_closest_error": f"WITH {PAIR}, n AS (SELECT vec_id, list_filter(list_transform(a, lambda x: list_min(list_transform(b, lambda y: abs(y - x)))), lambda d: d <= 0.01) AS d FROM p) SELECT vec_id, len(d) AS n, round(coalesce(list_sum(d), 0.0), 5) AS error FROM n",
    "array_smoothing": f"""{LONG}, s AS (SELECT vec_id, CASE WHEN lag(x, 2) OVER o IS NULL OR lead(x, 2) OVER o IS NULL THEN abs(x) ELSE greatest(0.0, (-3 * abs(lag(x, 2) OVER o) + 12 * abs(lag(x) OVER o) + 17 * abs(x) + 12 * abs(lead(x) OVER o) - 3 * abs(lead(x, 2) OVER o)) / 35.0) END AS s FROM l WINDOW o AS (PARTITION BY vec_id ORDER BY i))
      SELECT vec_id, round(sum(s), 4) AS total, round(max(s), 5) AS largest FROM s GROUP BY 1""",
    "array_longest_run": f"{LONG}, g AS (SELECT vec_id, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM l WHERE x > 0) SELECT vec_id, coalesce(max(n), 0) AS run FROM embeddings LEFT JOIN (SELECT vec_id, g, count(*) AS n FROM g GROUP BY 1, 2) USING (vec_id) GROUP BY 1",
    "array_best_matches": """WITH f AS (SELECT min(vec_id) AS query, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY label),
      s AS (SELECT query, vec_id, round(least(1.0, greatest(0.0, list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)))), 5) AS score FROM embeddings, f WHERE vec_id <> query)
      SELECT query, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS k FROM s WHERE score > 0) WHERE k <= 10""",
}
