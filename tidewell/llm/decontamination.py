"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

A document is contaminated by an item if some window of it, as many words long as the
item (or the whole document, if that is shorter), has weighted similarity ``similarity``
or more with it: five-word shingles, lower-cased, each weighted by how often it occurs,
shared weight by united weight.

1. Where a window can reach that similarity it holds one at least of any 1/5 of the
   item's shingles. The rarest such part of each item are its anchors: all shingles of all
   documents are looked up among the anchors, which say no more than how long their items
   are. Windows of that length around a hit are taken that begin with a shingle of an item
   or end the document; no other window can be the best.
2. Windows and items get a 64-bit SimHash, and windows find items by it alone: its 8
   blocks of 8 bits are indexed on the items' side under their anchors and all values up
   to 2 bits off, and a window looks up each of its blocks under the anchor that it was
   taken for. That guarantees that every pair up to RADIUS = 23 bits apart meets in one
   block. Pairs at the similarity limit are about 10 bits apart with a standard deviation
   of 3, so fewer than 1 in 100,000 are lost.
3. Pairs in the radius are verified exactly, on the words themselves.

Only the text decides, so equal texts are looked at once.

Defined cases: null texts have no words and match nothing; items of the same words are
one class, reported as its smallest item_id (null only if there is no other); items of
fewer words than a shingle match documents of just these words; repeated rows (same id
and text) are reported once; null ids are reported as null; empty tables give an empty
result; other columns are ignored, and kept by ``drop_contaminated``, which drops every
row of a contaminated text, whatever its id, and no other row.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.rows import let
from tidewell.storage import stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
#: Up to so many anchors (two longs each, some 40 bytes) are broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     "), " "), "")


def with_shingles(df: DataFrame, name: str = "shingles", k: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the hashes of the shingles of ``words``, in order.

    One expression with the words' hashes bound inside: if the optimizer repeats it, it
    repeats the whole, not the hashing of all words for each shingle.
    """

    def each(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))

    return df.withColumn(name, let(F.transform("words", lambda w: F.xxhash64(w)), each))


def item_classes(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n_items, words, cid): items by their words; item_id is the smallest of a class, cid numbers the classes."""
    rows = items.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    classes = rows.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    return stored(classes.withColumn("cid", F.monotonically_increasing_id()), "item_classes")


def anchors(shingled: DataFrame, similarity: float) -> DataFrame:
    """(h, cid, length): the rarest shingles of each class, so many that a similar window has one of them."""
    counted = shingled.select("cid", F.explode_outer("shingles").alias("h")).groupBy("cid", "h").agg(F.count("*").alias("times"))
    spread = counted.groupBy("h").agg(F.count("*").alias("items"))
    ranked = counted.join(spread, "h").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("items", "h", "times"))).alias("ranked"))
    n = F.size("shingles")
    least = n - F.ceil(n * F.lit(similarity) - 1e-9) + 1
    none = F.struct(F.lit(0).cast("long").alias("before"), F.array().cast("array<bigint>").alias("h"))
    taken = lambda a, x: F.when(a.before < least, F.struct((a.before + x.times).alias("before"), F.concat(a.h, F.array(x.h)).alias("h"))).otherwise(a)
    return shingled.join(ranked, "cid").select(F.explode(F.aggregate("ranked", none, taken).h).alias("h"), "cid", F.size("words").alias("length"))


def leaky_texts(texts: DataFrame, looked_up: DataFrame, max_broadcast: int) -> DataFrame:
    """(tkey, words, hits, shingles): texts with anchors, each once, and where these are (p, h, length).

    Only texts with hits move. Outer generators: of others the optimizer infers a filter
    that computes the array twice.
    """
    places = F.collect_set(F.struct("p", "h", "length")).alias("hits")
    each = F.posexplode_outer("shingles").alias("p", "h")
    if looked_up.count() <= max_broadcast:
        met = with_shingles(texts).select("tkey", "words", each).join(F.broadcast(looked_up), "h")
        found = met.groupBy("tkey").agg(F.first("words").alias("words"), places)
    else:
        met = with_shingles(texts).select("tkey", each).join(looked_up, "h")
        found = texts.dropDuplicates(["tkey"]).join(met.groupBy("tkey").agg(places), "tkey")
    return with_shingles(found)


def windows(leaky: DataFrame, item_shingles: DataFrame) -> DataFrame:
    """(tkey, start, length, h): the windows that can be similar to an item, and the anchors that they hold.

    They begin with a shingle of some item or end with the text: of two that are as similar as each other, one word apart,
    the one that begins with the item is found.

    ``leaky`` as ``leaky_texts`` gives it, ``item_shingles`` (h).
    """

    def around(hit: Column) -> Column:
        last = F.greatest(F.size("words") - hit.length, F.lit(0))
        first = F.greatest(hit.p - (hit.length - SHINGLE_WORDS), F.lit(0))
        # one shingle for each start, so rows hold no more of the text than an item's length
        run = F.slice("shingles", first + 1, F.least(hit.p, last) - first + 1)
        return F.struct(hit.h.alias("h"), hit.length.alias("length"), last.alias("last"), first.alias("first"), run.alias("run"))

    found = leaky.select("tkey", F.explode(F.transform("hits", around)).alias("x"))
    each = found.select("tkey", "x.h", "x.length", "x.last", "x.first", F.posexplode("x.run").alias("i", "begins"))
    each = each.select("tkey", (F.col("first") + F.col("i")).alias("start"), "length", "h", "last", "begins").distinct()
    begins = each.filter("start < last").join(item_shingles.select(F.col("h").alias("begins")), "begins", "left_semi")
    return begins.select("tkey", "start", "length", "h").unionByName(each.filter("start = last").select("tkey", "start", "length", "h"))


def with_simhash(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, fp) of rows (key, shingles): a bit is 1 if it is set in over half of the shingles. Counts of two bits share a long."""
    rows = rows.select(*key, F.explode_outer("shingles").alias("h"))
    pair = lambda b: F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1 | 1 << 32))
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"), *[F.sum(pair(b)).alias(f"c{b}") for b in range(32)])
    low = lambda b: F.col(f"c{b}").bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda b: F.shiftrightunsigned(f"c{b}", 32)
    bits = [F.when(c * 2 > F.col("n"), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(F.lit(0)).cast("long") for b, c in [*((b, low(b)) for b in range(32)), *((b + 32, high(b)) for b in range(32))]]
    return counts.select(*key, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fp"))


def _block(b: int) -> Column:
    return F.shiftrightunsigned("fp", b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def block_candidates(taken: DataFrame, window_fps: DataFrame, anchored: DataFrame, item_fps: DataFrame) -> DataFrame:
    """(tkey, start, length, cid): windows within RADIUS bits of an item that has an anchor of theirs, by the multi-index."""
    per_block = RADIUS // BLOCKS
    flips = [sum(1 << b for b in bits) for n in range(per_block + 1) for bits in combinations(range(BLOCK_BITS), n)]
    near = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _block(b).alias("value")) for b in range(BLOCKS)])).alias("k")
    index = anchored.join(item_fps, "cid").select("h", "length", "cid", F.col("fp").alias("item_fp"), near)
    index = index.select("h", "length", "cid", "item_fp", "k.block", "k.value", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    index = index.withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")
    looked = taken.join(window_fps, ["tkey", "start", "length"]).select("tkey", "start", "length", "h", "fp", near)
    met = looked.select("tkey", "start", "length", "h", "fp", "k.block", "k.value").join(index, ["h", "length", "block", "value"])
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("tkey", "start", "length", "cid").distinct()


def numbered_shingles(words: Column) -> Column:
    """The shingles themselves, each with how often it came before: sets of these overlap as the counts do."""
    k = SHINGLE_WORDS

    def number(each: Column) -> Column:
        once = F.transform(each, lambda x: F.concat(x, F.lit(" 0")))
        # sorted, equal ones stand together, and the place of the first says how many came before
        before = lambda s, x, i: F.when(F.get(s, i - 1) == x, i + 1 - F.array_position(s, x)).otherwise(0)
        often = let(F.array_sort(each), lambda s: F.transform(s, lambda x, i: F.concat_ws(" ", x, before(s, x, i).cast("string"))))
        return F.when(F.size(F.array_distinct(each)) == F.size(each), once).otherwise(often)

    return let(F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " ")), number)


def leaks(texts: DataFrame, items: DataFrame, similarity: float, max_broadcast: int) -> DataFrame:
    """(tkey, item_id, n_items, similarity, start_word, n_words) for ``texts`` (tkey, words), whose equal rows count once."""
    if similarity < SIMILARITY:
        raise ValueError(f"blocks of {RADIUS} bits find pairs of a similarity of {SIMILARITY} or more, not of {similarity}")
    classes = item_classes(items)
    named = classes.select(F.col("cid"), "item_id", "n_items")
    shingled = with_shingles(classes.filter(F.size("words") >= SHINGLE_WORDS))
    anchored = stored(anchors(shingled, similarity), "anchors")
    leaky = stored(leaky_texts(texts, stored(anchored.select("h", "length").distinct(), "looked_up"), max_broadcast), "leaky_texts")
    item_shingles = shingled.select(F.explode("shingles").alias("h")).distinct()
    taken = stored(windows(leaky, item_shingles), "windows")
    key = ["tkey", "start", "length"]
    shingles_in = F.slice("shingles", F.col("start") + 1, F.greatest(F.least(F.col("length"), F.size("words")) - (SHINGLE_WORDS - 1), F.lit(1)))
    distinct = taken.select(key).distinct()
    fps = with_simhash(distinct.join(leaky, "tkey").select(*key, shingles_in.alias("shingles")), key)
    close = stored(block_candidates(taken, fps, anchored, with_simhash(shingled, ["cid"])), "candidates")
    theirs = shingled.select("cid", F.size("words").alias("item_words"), numbered_shingles(F.col("words")).alias("theirs"))
    within = F.slice("words", F.col("start") + 1, F.col("length"))
    # within a row: as many shingles meet as the counts share
    common = F.size(F.array_intersect(numbered_shingles(within), "theirs"))
    pairs = close.join(leaky.select("tkey", "words"), "tkey").join(theirs, "cid")
    shared = pairs.select(*key, "cid", F.size(within).alias("n_words"), (F.col("item_words") - (SHINGLE_WORDS - 1)).alias("item_weight"), common.alias("common"))
    weight = F.col("n_words") - (SHINGLE_WORDS - 1)
    scored = shared.withColumn("similarity", F.col("common") / (weight + F.col("item_weight") - F.col("common"))).filter(F.col("similarity") >= similarity)
    best = scored.groupBy("tkey", "cid").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("b"))
    best = best.join(named, "cid").select("tkey", "item_id", "n_items", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).cast("long").alias("start_word"), F.col("b.n_words").cast("long").alias("n_words"))
    short = classes.filter(F.size("words") < SHINGLE_WORDS).select("item_id", "n_items", F.array_join("words", " ").alias("all"))
    if short.isEmpty():
        return best
    whole = texts.filter(F.size("words") < SHINGLE_WORDS).select("tkey", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("all")).distinct()
    return best.unionByName(whole.join(short, "all").select("tkey", "item_id", "n_items", F.lit(1.0).alias("similarity"), F.lit(0).cast("long").alias("start_word"), "n_words"))


def _texts(docs: DataFrame, text_col: str, *others: Column) -> DataFrame:
    return docs.select(*others, F.md5(F.col(text_col)).alias("tkey"), words(F.col(text_col)).alias("words"))


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, item_id, n_items, similarity, start_word, n_words): the most similar window of each document for each class of items it leaks."""
    found = stored(leaks(_texts(docs, text_col), items, similarity, max_broadcast), "leaks")
    named = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.col(text_col)).alias("tkey"))
    # first by the texts that leak, which are few, then one row for repeated ones
    leaking = named.join(found.select("tkey").distinct(), "tkey", "left_semi").distinct()
    return leaking.join(found, "tkey").select("doc_id", "item_id", "n_items", "similarity", "start_word", "n_words")


def drop_contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` without the rows whose text leaks an item."""
    found = stored(leaks(_texts(docs, text_col), items, similarity, max_broadcast).select(F.col("tkey").alias("_leaks")).distinct(), "leaks")
    return docs.join(found, F.md5(F.col(text_col)) == F.col("_leaks"), "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
