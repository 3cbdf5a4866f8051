"""Language identification: the family first, then the language within it.

Texts become counts of character n-grams. Linear support vector machines, one for each
family against the rest, choose the family; within it one-versus-one machines vote, so
that languages which are easily taken for each other are told apart by what differs
between these two alone. Machines are fitted on a sample of labelled rows that is bounded
per language, each in a task of its own; predictions read whole texts.

As a filter (``keep_identified``) it keeps the texts whose predicted language is wanted
that fit it: most of their letters are letters of that language, so texts of a script
that no machine has learned go.

Defined cases: ``und`` with score 0 if the text is null, empty or has no letter, or if
nothing could be learned; ties go to the language that is first by code point; rows
without language or id teach nothing; labels without a known family are families of
their own; repeated rows count as they are; an empty table gives an empty result. The
filter decides on each row by its text alone, and where nothing could be learned it keeps
every text that has a letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.storage import stored

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "as bn gu hi mr ne or pa sa ur",
    "semitic": "ar am he mt",
}
UNKNOWN = "und"
#: Rows that the machines are fitted on, for each language at most.
MAX_PER_LANG = 500
DIMS = 1 << 13
ORDERS = (1, 2, 3)
#: Code points whose n-grams are counted at once.
BLOCK = 1 << 20
EPOCHS, COST, SEED = 12, 4.0, 7
#: Share of a text's letters that its language's texts of the fit have, at least.
LEAST_LETTERS = 0.5
#: Share of a language's texts that a letter of its alphabet is in.
ALPHABET_SHARE = 0.05

_LETTERS: list[np.ndarray] = []


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes.split()), f"only {lang}")


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(indices, values) of the n-grams of all letters, or None without a letter. Other characters count as one space."""
    lowered = (text or "").lower()
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint64)
    points = np.concatenate(([32], points[letter | np.concatenate(([False], letter[:-1]))], [32])).astype(np.uint64)
    counts = np.zeros(DIMS)
    for begin in range(0, len(points), BLOCK):
        for n in ORDERS:
            part = points[begin : begin + BLOCK + n - 1]
            if len(part) < n:
                continue
            mixed = np.full(len(part) - n + 1, n, np.uint64)
            for k in range(n):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + part[k : len(part) - n + 1 + k]
            mixed = (mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - 13)
            counts += np.bincount(mixed.astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at])
    return at, values / np.linalg.norm(values)


def letters(text: str | None) -> np.ndarray:
    """Code points of the letters, lower-cased."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return points[_letters()[points]]


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by dual coordinate descent."""
    weights, alpha, bias = np.zeros(DIMS), np.zeros(len(rows)), 0.0
    size = np.array([v @ v + 1 + 0.5 / cost for _, v in rows])
    order = np.random.default_rng(SEED)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, values = rows[i]
            slope = signs[i] * (weights[at] @ values + bias) - 1 + alpha[i] * 0.5 / cost
            now = max(alpha[i] - slope / size[i], 0.0)
            if now != alpha[i]:
                step = (now - alpha[i]) * signs[i]
                weights[at] += step * values
                bias += step
                alpha[i] = now
    return np.append(weights, bias)


def problems(langs: list[str]) -> list[tuple[str, list[str], list[str]]]:
    """(name, languages on the positive side, on the negative side)."""
    families = sorted({family(x) for x in langs})
    inside = {f: [x for x in langs if family(x) == f] for f in families}
    found = [(f, inside[f], [x for x in langs if family(x) != f]) for f in families] if len(families) > 1 else []
    return found + [(f"{a} {b}", [a], [b]) for f in families for a, b in combinations(inside[f], 2)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_lang: int = MAX_PER_LANG) -> tuple[list[str], dict[str, np.ndarray], DataFrame | None]:
    """Languages, machines and the features they were fitted on (lang, at, val, letters), from rows that are not held out.

    The sample goes by a hash of the text: of each language, texts are drawn in the share that
    the bound has of its distinct texts.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & (_remainder(F.col(id_col)) != 2)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], {}, None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * max_per_lang / max(n, 1)))])
    drawn = labelled.withColumn("draw", F.xxhash64("text")).filter(F.pmod(F.col("draw"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("draw", "text"))
    sample = drawn.dropDuplicates(["lang", "text"]).withColumn("nth", nth).filter(F.col("nth") <= max_per_lang).select("lang", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [(lang, features(text), np.unique(letters(text))) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            each = [x for x in each if x[1] is not None]
            ints, floats = pa.list_(pa.int32()), pa.list_(pa.float32())
            columns = [pa.array([x[1][0].astype(np.int32) for x in each], ints), pa.array([x[1][1].astype(np.float32) for x in each], floats), pa.array([x[2].astype(np.int32) for x in each], ints)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in each], pa.string()), *columns], ["lang", "at", "val", "letters"])

    rows = stored(sample.mapInArrow(featured, "lang string, at array<int>, val array<float>, letters array<int>"), "langid_sample")
    tasks = problems(langs)
    if not tasks:
        return langs, {}, rows
    sides = F.array(*[F.struct(F.lit(name).alias("name"), F.when(F.col("lang").isin(plus), 1.0).when(F.col("lang").isin(minus), -1.0).alias("sign")) for name, plus, minus in tasks])
    dealt = rows.select("at", "val", F.explode(F.filter(sides, lambda s: s.sign.isNotNull())).alias("s")).select("s.name", "s.sign", "at", "val")

    def machine(group: pd.DataFrame) -> pd.DataFrame:
        # the order of rows decides the last digits; it goes by what they hold
        each = sorted(zip(group["sign"], group["at"], group["val"], strict=True), key=lambda r: (r[0], len(r[1]), bytes(np.asarray(r[2], np.float32))))
        weights = fit_svm([(np.asarray(a), np.asarray(v, np.float64)) for _, a, v in each], np.array([s for s, _, _ in each]))
        return pd.DataFrame({"name": [group["name"].iloc[0]], "weights": [weights]})

    fitted = dealt.groupBy("name").applyInPandas(machine, "name string, weights array<double>").collect()
    return langs, {r["name"]: np.array(r["weights"]) for r in fitted}, rows


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-4 * np.clip(margin, -50, 50))))


def predict(text: str | None, langs: list[str], machines: dict[str, np.ndarray]) -> tuple[str, float]:
    found = features(text)
    return (UNKNOWN, 0.0) if found is None or not langs else judge(*found, langs, machines)


def judge(at: np.ndarray, values: np.ndarray, langs: list[str], machines: dict[str, np.ndarray]) -> tuple[str, float]:
    """Language and score of a text's features."""

    def margin(name: str) -> float:
        w = machines.get(name)
        return 0.0 if w is None else float(w[at] @ values + w[-1])

    families = sorted({family(x) for x in langs})
    margins = {f: margin(f) for f in families}
    best = max(families, key=lambda f: margins[f])
    score = _chance(margins[best]) if len(families) > 1 else 1.0
    inside = [x for x in langs if family(x) == best]
    votes, certain = dict.fromkeys(inside, 0), dict.fromkeys(inside, 1.0)
    for a, b in combinations(inside, 2):
        m = margin(f"{a} {b}")
        votes[a if m >= 0 else b] += 1
        certain[a], certain[b] = min(certain[a], _chance(m)), min(certain[b], _chance(-m))
    lang = max(inside, key=lambda x: (votes[x], certain[x]))
    return lang, score * certain[lang]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_lang: int = MAX_PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; machines are fitted on the labelled rows of ``docs`` itself."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, max_per_lang)[:2])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(_remainder(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [predict(t.as_py(), *model.value) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in each], pa.string()), pa.array([s for _, s in each], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def known_letters(sample: DataFrame) -> dict[str, np.ndarray]:
    """The letters that ALPHABET_SHARE of a language's texts have, sorted: an alphabet each."""
    texts = sample.groupBy("lang").agg(F.count("*").alias("n"))
    each = sample.select("lang", F.explode("letters").alias("letter")).groupBy("lang", "letter").agg(F.count("*").alias("with"))
    each = each.join(texts, "lang").filter(F.col("with") >= ALPHABET_SHARE * F.col("n")).groupBy("lang").agg(F.sort_array(F.collect_list("letter")).alias("letters"))
    return {r["lang"]: np.array(r["letters"], np.uint32) for r in each.collect()}


def keep_identified(
    docs: DataFrame,
    languages: list[str] | None = None,
    least_score: float = 0.0,
    least_letters: float = LEAST_LETTERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_per_lang: int = MAX_PER_LANG,
) -> DataFrame:
    """``docs`` whose predicted language is one of ``languages`` (None: all learned ones) and fits the text.

    It fits if its score is ``least_score`` or more and if ``least_letters`` of the text's letters
    are of its alphabet. Where no language can be learned, texts with letters stay; to ask for
    languages or scores is an error then.
    """
    langs, machines, sample = fit(docs, id_col, text_col, lang_col, max_per_lang)
    if not langs:
        if (languages is not None or least_score > 0) and not docs.isEmpty():
            raise ValueError("no row has a language to learn from, so none can be asked for")
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    model = docs.sparkSession.sparkContext.broadcast((langs, machines, known_letters(sample)))
    wanted = set(langs if languages is None else languages)
    at = docs.columns.index(text_col)

    def kept(text: str | None) -> bool:
        lang, score = predict(text, *model.value[:2])
        return lang in wanted and score >= least_score and np.isin(letters(text), model.value[2].get(lang, ())).mean() >= least_letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(kept(t.as_py())) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
