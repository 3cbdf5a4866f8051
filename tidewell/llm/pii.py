"""Personal data by fixed patterns and bootstrapped contexts.

Matches of the four fixed patterns are the seeds. What stands around a seed, the word
before, the word after, the key that it is assigned to and the letters that it begins
with, are lexical patterns. Other strings that look like identifiers are candidates, with
the same patterns. Spark scores the graph of patterns and instances in turns: a pattern
by the scores of its distinct instances, an instance by its patterns; seeds stay at 1.
Candidates of high-confidence patterns are added to the spans as kind ``other``.

Defined cases: a null text is an empty one, whose lists are empty; spans are in code
points, ends exclusive; a match that fails its check is dropped and not retried; base
spans of different kinds may overlap; candidates that touch a base span are left out;
repeated rows count as they are, and null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.storage import stored

KINDS = ("email", "ip", "card", "phone", "other")
OTHER = len(KINDS) - 1
ROUNDS = 5
#: A pattern needs this many distinct instances and this score to add spans; PRIOR unknown instances are counted against each.
LEAST_INSTANCES, LEAST_SCORE, PRIOR = 5, 0.6, 4.0

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
VALUE = re.compile(r"[A-Za-z0-9_+/-]{8,}")
#: Digits alone, in groups with at most two marks between them, seven or more in all.
NUMBER = re.compile(r"\(?[0-9](?:[ .()/-]{0,2}[0-9]){6,24}")
KEY_BEFORE = re.compile(r"([A-Za-z_]{2,40})\s{0,3}[=:]\s{0,3}[\"']?\Z")
WORD_BEFORE = re.compile(r"(\S{1,40})\s{1,3}\Z")
WORD_AFTER = re.compile(r"\S{0,4}\s{1,3}(\S{1,40})")
EDGES = "\"'.,;:()[]{}<>!?"


def luhn(digits: str) -> bool:
    doubled = [int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end); each kind leftmost and without overlap."""
    found, upto = [], 0
    for m in DOMAIN.finditer(text):
        start = at = m.start()
        while start > upto and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at:
            found.append((start, 0, m.end()))
            upto = m.end()
    for m in IP.finditer(text):
        if all(len(part := p.lstrip("0")) <= 3 and int(part or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _context(text: str, start: int, end: int) -> list[str]:
    """Patterns of a span: its key, the word before it (or before its key), and the word after."""
    patterns, left = [], text[max(0, start - 60) : start]
    if key := KEY_BEFORE.search(left):
        patterns.append("key " + key[1].lower())
        left = left[: key.start()]
    if word := WORD_BEFORE.search(left):
        patterns.append("before " + DIGITS.sub("0", word[1].strip(EDGES).lower()))
    if word := WORD_AFTER.match(text, end, end + 60):
        patterns.append("after " + DIGITS.sub("0", word[1].strip(EDGES).lower()))
    head = text[start : start + 4]
    if len(head) == 4 and head.isascii() and head.isalpha() and head.isupper():
        patterns.append("head " + head)
    return patterns


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that could be identifiers, clear of ``base``: eight or more letters and digits with two digits and a letter at least,
    or seven or more digits in groups. Which of them are is left to the patterns."""
    found, numbers, upto = [], [], 0
    spans = sorted((s, e) for s, _, e in base)
    ends = list(accumulate((e for _, e in spans), max))
    for digit in DIGITS.finditer(text):
        if digit.start() < upto:
            continue
        start, end = digit.start(), digit.end()
        while start > upto and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        upto = end
        for m in VALUE.finditer(text, start, end):
            value = m.group()
            if sum(c.isdigit() for c in value) < 2 or not any(c.isalpha() for c in value):
                continue
            found.append((m.start(), m.end()))
    taken, upto = found, 0
    for m in NUMBER.finditer(text):
        while upto < len(taken) and taken[upto][1] <= m.start():
            upto += 1
        if upto == len(taken) or taken[upto][0] >= m.end():
            numbers.append((m.start(), m.end()))

    def clear(span: tuple[int, int]) -> bool:  # of the base spans that begin before it ends, none reaches into it
        n = bisect_left(spans, (span[1], 0))
        return n == 0 or ends[n - 1] <= span[0]

    return [span for span in sorted(found + numbers) if clear(span)]


MENTION = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mentions): base spans and candidates of each row, with instance and patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = [*base, *((s, OTHER, e) for s, e in candidates(text, base))]
                rows.append([{"start": s, "kind": k, "end": e, "instance": text[s:e], "patterns": _context(text, s, e)} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(MENTION))], ["doc_id", "mentions"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shape = "array<struct<start:int,kind:int,end:int,instance:string,patterns:array<string>>>"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mentions {shape}")


def high_confidence(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score): patterns that add spans, from (pattern, instance, seed), a row for each link once."""
    graph = stored(graph, "pattern_graph")
    seeds = F.when(F.col("seed"), 1.0).otherwise(0.0)
    scores = graph.groupBy("instance").agg(F.max(seeds).alias("x"))
    for n in range(rounds):
        scores = stored(scores, f"instances_{n}")
        patterns = graph.join(scores, "instance").groupBy("pattern").agg(F.count("*").alias("n"), (F.sum("x") / (F.count("*") + PRIOR)).alias("score"))
        patterns = stored(patterns.filter(F.col("n") >= LEAST_INSTANCES), f"patterns_{n}")
        doubt = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999))))
        scores = graph.join(patterns, "pattern", "left").groupBy("instance").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(F.coalesce(doubt, F.lit(0.0)))).alias("x"))
    return patterns.filter(F.col("score") >= LEAST_SCORE).select("pattern", "score")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, added) per row: arrays of (start, kind, end) in order."""
    found = stored(mentions(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "mentions")
    span = lambda m: F.struct(m.start.alias("start"), m.kind.alias("kind"), m.end.alias("end"))
    base = F.array_sort(F.transform(F.filter("mentions", lambda m: m.kind != OTHER), span))
    each = found.filter(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m"))
    links = each.select(F.explode("m.patterns").alias("pattern"), F.xxhash64("m.instance").alias("instance"), (F.col("m.kind") != OTHER).alias("seed"))
    links = links.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    good = stored(high_confidence(links, rounds), "good_patterns")
    spotted = each.filter(F.col("m.kind") == OTHER).select("row", "m.start", "m.kind", "m.end", F.explode("m.patterns").alias("pattern")).join(good.select("pattern"), "pattern", "left_semi")
    added = spotted.select("row", "start", "kind", "end").distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return found.join(added, "row", "left").select("doc_id", base.alias("base"), F.coalesce("added", none).alias("added"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[removed]") -> DataFrame:
    """``docs`` with every base match in its text replaced by ``mark``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = batch.schema.get_field_index(text_col), []
            for value in batch.column(at):
                text, parts, upto = value.as_py(), [], 0
                for start, _, end in base_spans(text or ""):
                    if end > upto:
                        parts += [text[upto:start], mark] if start >= upto else []
                        upto = end
                out.append(None if text is None else "".join([*parts, text[upto:]]))
            yield batch.set_column(at, text_col, pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter(F.transform("base", lambda s: s.kind), lambda x: x == F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:OTHER])]
    both = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(both).alias("spans"))
