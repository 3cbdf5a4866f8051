"""Toxicity by a chain of classifiers.

The categories of the label table are predicted one after another; each linear model
also reads the probabilities of the categories before it. While fitting, these are
out-of-fold: those of a row come from a model that hasn't seen it, so a later model
doesn't learn to trust an earlier one more than it deserves. Features are words and word
beginnings; which ones tell a category apart is counted by Spark over the sample, for
each fold's models without that fold, so out-of-fold chances owe nothing to the labels
of the rows that they are for. The sample and the number of features (MAX_FEATURES, the
most telling ones) are bounds of the fit; prediction reads all words.

The sample is bounded per class of the last category and weighted back, so chances are
those of all labelled rows; its texts and all predicted texts are read whole.

Defined cases: a null text is one without words; rows without label teach nothing; a
category of which the labels know one value only has that value's chance everywhere; no
labels at all give chance 0; labels of several rows of an id count each; repeated rows
count as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.storage import stored

CATEGORIES = ("quality", "toxic")
#: Rows of each class of the last category that models are fitted on, at most.
MAX_PER_CLASS = 3000
MAX_FEATURES = 1500
#: Standard errors by which a feature's share must differ between a category's two classes, and documents that must have it.
LEAST_Z, LEAST_DOCS = 4.0, 5
FOLDS = 3
PENALTY = 1.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5
WORDS = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """Distinct words, and the beginnings of longer ones, marked with a caret."""
    words = set(WORDS.findall((text or "").lower()))
    return words | {"^" + w[:n] for n in PREFIXES for w in words if len(w) > n}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Coefficients and intercept of an L2 logistic model, by Newton's method with step halving."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6

    def loss(b):
        z = x @ b
        return weight @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge @ (b * b)

    beta, now = np.zeros(x.shape[1]), np.inf
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        slope = x.T @ (weight * (p - y)) + ridge * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(ridge)
        step, before, size = np.linalg.solve(curve, slope), loss(beta), 1.0
        while size > 1e-4 and loss(beta - size * step) > before:
            size /= 2
        beta = beta - size * step
        now = loss(beta)
        if before - now < 1e-7 * max(1.0, abs(before)):
            break
    return beta


def chances(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -35, 35)))


def _sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_per_class: int) -> DataFrame:
    """(label of each category, weight, fold, text) of at most ``max_per_class`` rows of each class of the last category."""
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    last = categories[-1]
    counts = {r[last]: r["n"] for r in known.groupBy(last).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs.select("doc_id", "text").join(known, "doc_id").select(*categories, F.lit(1.0).alias("weight"), F.lit(0).alias("fold"), "text")
    share = F.create_map(*[F.lit(x) for value, n in counts.items() for x in (value, min(1.0, 1.2 * max_per_class / n))])
    weight = F.create_map(*[F.lit(x) for value, n in counts.items() for x in (value, n / min(n, max_per_class))])
    drawn = known.withColumn("draw", F.xxhash64("doc_id")).filter(F.pmod("draw", F.lit(1 << 20)) < share[F.col(last)] * (1 << 20))
    nth = F.row_number().over(W.partitionBy(last).orderBy("draw"))
    drawn = stored(drawn.withColumn("nth", nth).filter(F.col("nth") <= max_per_class).drop("nth"), "toxicity_ids")
    # max_per_class rows of ids and labels for each class at most, so texts needn't move to meet them
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    nth = F.row_number().over(W.partitionBy(last).orderBy("draw", "text"))
    return joined.withColumn("nth", nth).filter(F.col("nth") <= max_per_class).select(*categories, weight[F.col(last)].alias("weight"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text")


def _vocabularies(rows: DataFrame, categories: Sequence[str]) -> dict[int, list[str]]:
    """For each fold left out (-1: none), features whose share of documents differs between the classes of a category, the most telling first."""
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]]
    by_fold = {r["fold"]: r for r in rows.groupBy("fold").agg(*sums).collect()}  # FOLDS rows
    seen = stored(rows.select("fold", *categories, F.explode("words").alias("word")).groupBy("word", "fold").agg(*sums), "toxicity_words")
    found = {}
    for held in range(-1, FOLDS):
        total = lambda c, held=held: sum(r[c] or 0 for f, r in by_fold.items() if f != held)
        n, scores = total("n"), []
        for c in categories:
            ones = total(c)
            if 0 < ones < n:
                share, all_share = F.col(c) / ones - (F.col("n") - F.col(c)) / (n - ones), (F.col("n") + 1) / n
                scores.append(F.abs(share) / F.sqrt(all_share * (1 / ones + 1 / (n - ones))))
        if not scores:
            found[held] = []
            continue
        z = F.greatest(*scores) if len(scores) > 1 else scores[0]
        counted = seen.filter(F.col("fold") != held).groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in categories])
        telling = counted.filter(F.col("n") >= LEAST_DOCS).select("word", z.alias("z")).filter(F.col("z") >= LEAST_Z)
        found[held] = [r["word"] for r in telling.orderBy(F.col("z").desc(), "word").limit(MAX_FEATURES).collect()]
    return found


def _bound(model, before: list[list[np.ndarray]], at: int):
    return lambda group: model(group, before, at)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, max_per_class: int = MAX_PER_CLASS) -> tuple[list[str], list[np.ndarray]]:
    """The vocabulary, and for each category the coefficients of words, of earlier categories and the intercept."""

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([sorted(features(t.as_py())) for t in batch.column("text")], pa.list_(pa.string()))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), words], [*names, "words"])

    sample = _sample(docs, labels, categories, max_per_class)
    shape = ", ".join(f"{c} int" for c in categories)
    rows = stored(sample.mapInArrow(worded, f"{shape}, weight double, fold int, words array<string>"), "toxicity_sample")
    vocabularies = _vocabularies(rows, categories)
    places = {held: {w: i for i, w in enumerate(words)} for held, words in vocabularies.items()}
    union = sorted({w for words in vocabularies.values() for w in words})
    picked = F.array_intersect("words", F.array(*map(F.lit, union))) if union else F.array().cast("array<string>")
    rows = stored(rows.select(*categories, "weight", "fold", picked.alias("words")), "toxicity_features")
    names = list(categories)

    def one_hot(texts: pd.Series, place: dict[str, int]) -> np.ndarray:
        x = np.zeros((len(texts), len(place)))
        for i, words in enumerate(texts):
            x[i, [place[w] for w in words if w in place]] = 1
        return x

    def model(group: pd.DataFrame, before: list[list[np.ndarray]], at: int) -> pd.DataFrame:
        """The model of a category without one fold, or of all rows (fold -1)."""
        held = int(group["held"].iloc[0])
        group = group.assign(key=[" ".join(w) for w in group["words"]]).sort_values(["key", *names, "fold", "weight"])
        folds, earlier = group["fold"].to_numpy(), np.zeros((len(group), at))
        for f in range(FOLDS) if at else ():  # a row's earlier chances are those of the models that haven't seen its fold
            mine = folds == f
            x = one_hot(group["words"][mine], places[f])
            for k in range(at):
                earlier[mine, k] = chances(np.hstack([x, earlier[mine, :k]]), before[k][f])
        x = np.hstack([one_hot(group["words"], places[held]), earlier])
        mine = folds != held
        if not mine.any():
            mine[:] = True
        y = group[names[at]].to_numpy(float)
        return pd.DataFrame({"held": [held], "beta": [fit_logistic(x[mine], y[mine], group["weight"].to_numpy()[mine])]})

    chain: list[np.ndarray] = []
    before: list[list[np.ndarray]] = []
    for at in range(len(names)):
        held = range(FOLDS) if at + 1 < len(names) else ()
        dealt = rows.select("*", F.explode(F.array(*map(F.lit, [-1, *held]))).alias("held"))
        fit_one = _bound(model, list(before), at)
        fitted = {r["held"]: np.array(r["beta"]) for r in dealt.groupBy("held").applyInPandas(fit_one, "held int, beta array<double>").collect()}
        none = lambda f, at=at: np.append(np.zeros(len(places[f]) + at), -35.0)
        chain.append(fitted.get(-1, none(-1)))
        before.append([fitted.get(f, none(f)) for f in range(FOLDS)])
    return vocabularies[-1], chain


def score(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, a chance p_<category> for each, and <last category> as a boolean."""
    vocabulary, chain = fit_chain(docs, labels, categories, **options)
    shared = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(vocabulary)}, chain))
    names = [f"p_{c}" for c in categories]
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, models = shared.value
        known = place.keys()
        for batch in batches:
            found = []
            for text in batch.column(1):
                at = sorted(place[w] for w in features(text.as_py()) & known)
                earlier: list[float] = []
                for beta in models:
                    z = beta[at].sum() + beta[len(place) : -1] @ np.array(earlier) + beta[-1]
                    earlier.append(float(1 / (1 + np.exp(-np.clip(z, -35, 35)))))
                found.append(earlier)
            columns = [pa.array([x[k] for x in found], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))
    return scored.withColumn(categories[-1], F.col(names[-1]) >= threshold)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
