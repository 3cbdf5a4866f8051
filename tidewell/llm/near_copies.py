"""Near copies of a stated similarity, by SimHash counts and tables of distances to pivots.

The pipeline's form of the SimHash operator: five-word shingles and a Jaccard similarity
of 0.8, where fingerprints of 64 bits are about 10 bits apart and no radius both holds
such pairs and leaves others out. So the counts of a SimHash are kept instead of their
signs: they say how far a text's shingle hashes are, on average, from any reference
fingerprint (pivot), and the pivot table holds these distances in standard units.

1. Which pairs are looked at: pivots form sets of BITS orthogonal fingerprints, and of
   each set the nearest (or farthest) pivot of a text is noted. Texts that have three of
   these in common, out of KEYS triples, meet. A pair at 0.8 is missed in 0.7 % of cases
   (simulated), at 0.85 in under 1 in 1000; texts that have nothing to do with each other
   share one of the 2 ** 27 triples of a key by chance.
2. A pair is discarded if it differs in any coordinate of its pivot table by over LIMIT:
   4.8 standard deviations of such a difference at 0.8, which leaves 0.4 % of other pairs.
3. What survives is verified exactly, on the sets of shingles.

Equal sets are one node from there on. A key is first stood for by one of its nodes, and
each node compared with the few of these that share most keys with it. Only keys that this leaves in several components are looked at again. Of their
nodes those go first that have so many shingles which none of the others has that no pair
with them reaches 0.8, which is exact: copies of one text that are unlike each other share
keys, but each has its own changes. The rest get a table of WIDE pivots, and each key is
swept in its task, where the table's distances discard pairs whose similarity they
estimate to be 4.5 standard deviations below 0.8. So the components are those of all pairs
that meet, and pairs are made of survivors only.

Defined cases: ASCII letters are folded; with fewer words than a shingle has, the whole
sequence is the shingle; texts without words (and null texts) equal each other only; ids
may be null or repeat, and rows count by all their columns; an empty table gives an empty
result; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.rows import KEY, keep, row_key
from tidewell.llm.simhash import LOWER
from tidewell.operators.components import connected_components
from tidewell.storage import stored

SHINGLE_WORDS = 5
#: The least similarity of near copies, as a fraction of whole numbers.
LEAST = (4, 5)
SEED = 42
#: Bits of a shingle's hash that are counted; pivots of a set; sets of which the nearest pivot is noted.
BITS, SETS = 256, 128
#: A key is the nearest pivots of set i and of those so far from it; one key for each set.
STEPS = (0, 7, 31)
KEYS = SETS
#: Coordinates of the pivot table, steps of a coordinate to a standard deviation, and the largest difference of similar texts.
COORDINATES, UNIT = 48, 16
LIMIT = int(4.8 * UNIT * np.sqrt(2 * (1 - 8 / 9)))
#: A key's first node by one of these orders stands for it, so that texts on the edge of a large group meet several of it.
ORDERS = (0, 0x5DEECE66D5DEECE6)
#: Of the nodes that stand for its keys, each node is first compared with so many, those with which it shares most keys.
HUBS = 16
#: Pivots of the wide table, and its steps to a standard deviation: STEPS_WIDE on either side of 0, so that two distances fit a byte.
WIDE, UNIT_WIDE, STEPS_WIDE = 1024, 3, 7
#: The least cosine of two of its rows at a similarity of 0.8: 4.5 standard deviations below the mean (both simulated).
LEAST_COSINE = 0.8793 - 4.5 * 0.00701
#: Rows that a sweep compares at once with as many others.
SWEEP = 2048
#: Shingles whose bits are counted at once.
BLOCK = 255 * 16


def _pivots() -> np.ndarray:
    """SETS + 1 sets of BITS reference fingerprints as rows of 1 and -1; those of a set differ in half of their bits."""
    square = np.ones((1, 1), np.float32)
    while len(square) < BITS:
        square = np.block([[square, square], [square, -square]])
    signs = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (SETS + 1, 1, BITS))
    return square[None, :, :] * signs


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64))


def bit_counts(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each of ``bits`` bits drawn from the hashes: how many have it set, less how many do not."""
    counts = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK, None] + np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        each = np.unpackbits((part ^ (part >> np.uint64(31))).view(np.uint8), axis=1)
        for j in range(0, len(each), 255):
            counts += each[j : j + 255].sum(axis=0, dtype=np.uint8)
    return 2 * counts - len(hashes)


def pivot_tables(counts: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, coordinates) of rows of counts: nearest pivots of the sets' triples, and standardised distances to COORDINATES others."""
    spread = np.linalg.norm(counts, axis=1, keepdims=True).astype(np.float32)
    unit = counts.astype(np.float32) / np.maximum(spread, 1e-9)
    nearest = np.empty((len(unit), SETS), np.uint64)
    for s in range(SETS):
        away = unit @ pivots[s].T
        at = np.abs(away).argmax(axis=1)
        nearest[:, s] = 2 * at + (away[np.arange(len(at)), at] > 0)
    keys = np.broadcast_to(np.arange(KEYS, dtype=np.uint64), nearest.shape).copy()
    for step in STEPS:
        keys = keys * np.uint64(2 * BITS) + np.roll(nearest, -step, axis=1)
    away = unit @ pivots[SETS][:COORDINATES].T
    return keys.view(np.int64), np.clip(np.rint(away * UNIT), -127, 127).astype(np.int8)


def wide_table(counts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Standardised distances of rows of WIDE counts to as many pivots, those of each BITS of them to a set's."""
    unit = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9) * np.sqrt(WIDE / BITS)
    away = np.concatenate([unit[:, i : i + BITS].astype(np.float32) @ pivots[s].T for s, i in enumerate(range(0, WIDE, BITS))], axis=1)
    steps = (np.clip(np.rint(away * UNIT_WIDE), -STEPS_WIDE, STEPS_WIDE) + STEPS_WIDE).astype(np.uint8)
    return steps[:, 0::2] << 4 | steps[:, 1::2]


def wide_rows(tables: list[bytes]) -> np.ndarray:
    """The steps of rows of the wide table, as vectors of length one (in another order of pivots, the same for all)."""
    both = np.frombuffer(b"".join(tables), np.uint8).reshape(-1, WIDE // 2)
    rows = np.concatenate([both >> 4, both & 15], axis=1).astype(np.float32) - STEPS_WIDE
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def shingle_sets(rows: DataFrame, kept: str, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, _row_key, text_key, node, n, ...) of rows (doc_id, _row_key, text_key, text).

    node is the XXH64 of the set and n its size. With ``kept`` "shingles", the set; with
    "pivots", keys and coordinates; with "wide", the wide table, a byte for two pivots.
    """
    found = {"shingles": "shingles array<bigint>", "pivots": "keys array<bigint>, coordinates array<tinyint>", "wide": "wide binary"}[kept]
    names = [x.split()[0] for x in found.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = _pivots()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py(), shingle_words) for t in part.column(3)]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                if kept == "shingles":
                    arrays = [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
                elif kept == "wide":
                    arrays = [pa.array([x.tobytes() for x in wide_table(np.array([bit_counts(s, WIDE) for s in sets]), pivots)], pa.binary())]
                else:
                    keys, places = pivot_tables(np.array([bit_counts(s) for s in sets]), pivots)
                    some = [len(s) > 0 for s in sets]
                    arrays = [pa.array([x if y else x[:0] for x, y in zip(keys, some, strict=True)], pa.list_(pa.int64())), pa.array(list(places), pa.list_(pa.int8()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), *arrays], ["doc_id", KEY, "text_key", "node", "n", *names])

    rows = rows.select("doc_id", KEY, "text_key", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {KEY} string, text_key bigint, node bigint, n bigint, {found}")


def not_discarded(pairs: DataFrame, tables: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose pivot tables differ by LIMIT at most everywhere, and whose sizes allow the similarity."""
    left = tables.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("coordinates").alias("x"))
    right = tables.select(F.col("node").alias("b"), F.col("n").alias("k"), F.col("coordinates").alias("y"))
    top, bottom = LEAST
    sizes = F.least("m", "k") * bottom >= F.greatest("m", "k") * top
    far = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p.cast("int") - q.cast("int"))))
    return pairs.join(left, "a").join(right, "b").filter(sizes & (far <= LIMIT)).select("a", "b")


def texts_of(placed: DataFrame, texts: DataFrame, holders: DataFrame) -> DataFrame:
    """A row of ``texts`` for each node of ``placed``."""
    asked = placed.select("node").distinct().join(holders, "node").select("text_key").distinct()
    return texts.join(asked, "text_key", "left_semi").dropDuplicates(["text_key"])


def parted(placed: DataFrame) -> DataFrame:
    """The rows (key, node, part, n) of those keys that are in several parts and have pairs to compare, and the least n of the key.

    Of a key of two nodes there are none if ``compared``: one of them has stood for the key, and the other met all its hubs.
    """
    key = W.partitionBy("key")
    ends = {"least": F.min("part").over(key), "most": F.max("part").over(key), "fewest": F.min("n").over(key)}
    left = {"members": F.count("*").over(key), "done": F.min("compared").over(key)}
    return placed.withColumns(ends | left).filter("least <> most AND NOT (members = 2 AND done)").select("key", "node", "part", "n", "fewest")


def unlike_all(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes (node) of ``placed`` that can't be similar to any other that they share a key with; ``sets`` has (node, shingles) of all.

    Of a set of n shingles, own are in no other of the sets. It shares n - own at most with one of m, so their
    similarity is at most (n - own) / (m + own), where m is at least the key's fewest and LEAST of n.
    """
    top, bottom = LEAST
    once = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("times"), F.min("node").alias("node"))
    own = once.filter("times = 1").groupBy("node").agg(F.count("*").alias("own"))
    fewest = F.greatest(F.col("fewest") * bottom, F.col("n") * top)  # m, bottom times
    sizes = placed.groupBy("node").agg(F.min("n").alias("n"), F.min(fewest).alias("m"))
    return own.join(sizes, "node").filter((F.col("n") - F.col("own")) * bottom * bottom < (F.col("m") + F.col("own") * bottom) * top).select("node")


def swept(placed: DataFrame, wide: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of a key that are in different parts and that their wide tables don't discard.

    ``placed`` has (key, node, part), ``wide`` (node, wide).
    """

    def pairs(nodes: np.ndarray, parts: np.ndarray, tables: list[bytes]) -> Iterator[pa.RecordBatch]:
        if parts[0] == parts[-1]:
            return
        rows = wide_rows(tables)
        for i in range(0, len(rows), SWEEP):
            for j in range(i, len(rows), SWEEP):
                near = rows[i : i + SWEEP] @ rows[j : j + SWEEP].T >= LEAST_COSINE
                near &= parts[i : i + SWEEP, None] < parts[None, j : j + SWEEP]  # sorted by part
                p, q = np.nonzero(near)
                a, b = nodes[i + p], nodes[j + q]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, parts, tables = None, [], [], []
        for batch in batches:
            for k, node, part, table in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(nodes) > 1:
                        yield from pairs(np.array(nodes), np.array(parts), tables)
                    key, nodes, parts, tables = k, [], [], []
                nodes.append(node)
                parts.append(part)
                tables.append(table)
        if len(nodes) > 1:
            yield from pairs(np.array(nodes), np.array(parts), tables)

    rows = placed.join(wide, "node").select("key", "node", "part", "wide").repartition("key").sortWithinPartitions("key", "part", "node")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, texts: DataFrame, holders: DataFrame, shingle_words: int, name: str) -> DataFrame:
    """Those of the pairs whose sets' similarity is LEAST or more; only their sets are made again, from ``texts``."""
    pairs = stored(pairs, f"{name}_pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(holders, "node").select("text_key").distinct()
    rows = texts.join(asked, "text_key", "left_semi").dropDuplicates(["text_key"])
    sets = stored(shingle_sets(rows, "shingles", shingle_words).select("node", "shingles").dropDuplicates(["node"]), f"{name}_sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both, (top, bottom) = F.size(F.array_intersect("x", "y")), LEAST
    return stored(pairs.join(left, "a").join(right, "b").filter(both * bottom >= (F.size("x") + F.size("y") - both) * top).select("a", "b"), f"{name}_links")


def links(nodes: DataFrame, texts: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(a, b): links among nodes whose components are those of all similar pairs that share a key.

    ``nodes`` has (node, n, text_key, keys, coordinates), a row for each set.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    mine = F.pmod(F.floor(F.col("key") / float((2 * BITS) ** len(STEPS))), F.lit(len(ORDERS)))  # by the key's set
    flip = F.element_at(F.array(*map(F.lit, ORDERS)), (mine + 1).cast("int"))
    order = F.col("node").bitwiseXOR(flip)
    crowd = keyed.groupBy("key").agg(F.min(order).alias("low"), F.max(order).alias("high")).filter("low <> high").select("key", F.col("low").bitwiseXOR(flip).alias("hub"))
    shared = stored(keyed.join(crowd, "key"), "shared_keys")
    tables, holders = nodes.select("node", "n", "coordinates"), nodes.select("node", "text_key")
    met = shared.filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("times"))
    most = F.row_number().over(W.partitionBy("node").orderBy(F.desc("times"), "hub"))  # of a text's KEYS at most
    stars = met.withColumn("nth", most).filter(F.col("nth") <= HUBS).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    first = verified(not_discarded(stars, tables), texts, holders, shingle_words, "star")

    roots = connected_components(first).select("node", "root", F.lit(False).alias("many"))
    crowded = met.groupBy("node").agg(F.count("*").alias("hubs")).filter(F.col("hubs") > HUBS).select("node", F.lit(None).cast("bigint").alias("root"), F.lit(True).alias("many"))
    known = roots.unionByName(crowded).groupBy("node").agg(F.min("root").alias("root"), F.max("many").alias("many"))
    parts = nodes.select("node", "n").join(known, "node", "left").select("node", "n", F.coalesce("root", "node").alias("part"), F.coalesce("many", F.lit(False)).alias("many"))
    compared = (F.col("node") == F.col("hub")) | ~F.col("many")
    placed = stored(parted(shared.join(parts, "node", "left").withColumn("compared", compared)), "parted_keys")
    unlike = unlike_all(placed, shingle_sets(texts_of(placed, texts, holders), "shingles", shingle_words))
    placed = stored(parted(placed.join(unlike, "node", "left_anti").withColumn("compared", F.lit(False))).select("key", "node", "part"), "swept_keys")
    wide = stored(shingle_sets(texts_of(placed, texts, holders), "wide", shingle_words).select("node", "wide").dropDuplicates(["node"]), "wide_tables")
    return first.unionByName(verified(swept(placed, wide), texts, holders, shingle_words, "rest"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(_row_key, doc_id, component_id) per row: component_id is the node that names all that links of similarity LEAST or more reach."""
    texts = docs.select(F.col(id_col).alias("doc_id"), row_key(docs).alias(KEY), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    rows = stored(shingle_sets(texts, "pivots", shingle_words), "pivot_tables")
    nodes = stored(rows.select("node", "n", "text_key", "keys", "coordinates").dropDuplicates(["node"]), "nodes")
    roots = connected_components(links(nodes, texts, shingle_words))
    return rows.select(KEY, "doc_id", "node").join(roots, "node", "left").select(KEY, "doc_id", F.coalesce("root", "node").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id, null last; of equal rows any one."""
    return keep(docs, near_groups(docs, id_col, text_col, **options))
