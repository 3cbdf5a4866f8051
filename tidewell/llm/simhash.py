"""Near-duplicate groups by SimHash with pivot distance tables.

Every text gets a 64-bit SimHash of its word shingles; equal fingerprints are one from
there on. The pivot table holds each fingerprint's Hamming distances to reference
fingerprints (pivots), block by block: the 64 bits form radius + 2 blocks, and the sum of
a pivot's distances over the blocks is its distance on the whole.

1. Which pairs are looked at is read from the table. Two fingerprints within the radius
   agree in two blocks at least, so by the triangle inequality within these blocks none
   of the pivots tells them apart there: fingerprints meet where all distances on a pair
   of blocks are equal, and no pair within the radius is lost.
2. A pair that meets is discarded if its largest difference of a whole distance is over
   the radius, again by the triangle inequality.
3. The survivors are verified bit by bit.

A key's rows are swept in the order of the first pivot's distance and give a spanning
forest of the verified links, not all pairs. Keys with more than ``max_key_rows``
fingerprints are not cut: their rows get pivots of their own, all values within half the
radius of a row. Two rows within the radius are both near one of these, and two rows near
one of these are within the radius, so rows are linked with the smallest at each.

Defined cases: a null text is one without words; its fingerprint is zero and is linked
like any other; with fewer words than a shingle has, the whole sequence is the shingle;
repeated rows and ids give as many rows; null ids count only if a group has no other; an
empty table gives an empty result; other columns are ignored, and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.rows import KEY, keep, row_key
from tidewell.operators.components import connected_components
from tidewell.storage import stored

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Pivots; a block's distances to them are packed into one long, so ten at most.
N_PIVOTS = 10
PACK = 6
MAX_KEY_ROWS = 2048
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 values."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], dtype=">u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, named: bool = False) -> DataFrame:
    """(doc_id, fp), fp as a signed long; with ``named`` also _row_key."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *([row_key(docs).alias(KEY)] if named else []))
    others = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(0)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], [*others, "fp"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in others) + ", fp bigint")


def pivots(n: int = N_PIVOTS) -> list[int]:
    return [xxhash.xxh64_intdigest(str(i), SEED) - (1 << 63) for i in range(n)]


def blocks(n: int) -> list[int]:
    """Masks of n blocks of the 64 bits, as signed longs."""
    edges = [64 * i // n for i in range(n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in (((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False))]


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each index's component; links from a to b, both below n."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if np.array_equal(root[a], root[b]):
            return root


def _sweep(keys: np.ndarray, which: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as fingerprints) that hold together what is linked among rows of an equal key; rows sorted by key and first coordinate."""
    first, found = table[:, 0].astype(np.int16), []
    at, step = np.arange(len(fps)), 0
    while len(at):
        step += 1
        at = at[at + step < len(fps)]
        other = at + step
        near = (keys[at] == keys[other]) & (which[at] == which[other]) & (first[other] - first[at] <= radius)
        at, other = at[near], other[near]
        close = np.abs(table[at].astype(np.int16) - table[other]).max(axis=1, initial=0) <= radius
        i, j = at[close], other[close]
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        found.append((i[ok], j[ok]))
    i, j = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    root = _roots(i, j, len(fps))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def pivot_table(distinct: DataFrame, radius: int, n_pivots: int) -> DataFrame:
    """(fp, parts, table): packed distances to the pivots on each block, and the distances on the whole."""
    apart = [F.col("fp").bitwiseXOR(F.lit(p)) for p in pivots(n_pivots)]
    parts = [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.bit_count(x.bitwiseAND(F.lit(m))).cast("long"), PACK * i) for i, x in enumerate(apart)]) for m in blocks(radius + 2)]
    return distinct.select("fp", F.array(*parts).alias("parts"), F.array(*[F.bit_count(x).cast("byte") for x in apart]).alias("table"))


def candidate_keys(table: DataFrame, radius: int) -> DataFrame:
    """(fp, table, which, key): the pairs of blocks, and what the pivot table says of each of them."""
    pairs = combinations(range(radius + 2), 2)
    keys = F.array(*[F.struct(F.lit(n).cast("byte").alias("which"), F.xxhash64(F.get("parts", F.lit(a)), F.get("parts", F.lit(b))).alias("key")) for n, (a, b) in enumerate(pairs)])
    return table.select("fp", "table", F.explode(keys).alias("k")).select("fp", "table", "k.which", "k.key")


def links(distinct: DataFrame, radius: int = RADIUS, n_pivots: int = N_PIVOTS, max_key_rows: int = MAX_KEY_ROWS) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp`` whose components are those of all pairs within the radius."""
    table = stored(pivot_table(distinct, radius, n_pivots), "pivot_table")
    keyed = candidate_keys(table, radius)
    sizes = keyed.groupBy("which", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(keyed.join(sizes, ["which", "key"]), "shared_keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def swept(parts):
            a, b = _sweep(*parts, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            key, which, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "which", "fp"))
            rows = batch.column("table").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_pivots)
            parts = [key, which, fp, rows]
            if held:
                parts = [np.concatenate(x) for x in zip(held, parts, strict=True)]
            last = (parts[0] == parts[0][-1]) & (parts[1] == parts[1][-1]) if len(parts[0]) else np.zeros(0, bool)
            cut = int(np.argmax(last)) if len(last) else 0
            if cut:
                yield swept([x[:cut] for x in parts])
            held = [x[cut:] for x in parts]
        if held:
            yield swept(held)

    few = shared.filter(F.col("n") <= max_key_rows).drop("n").repartition("which", "key").sortWithinPartitions("which", "key", F.col("table")[0])
    by_sweep = few.mapInArrow(run, "a bigint, b bigint").distinct()
    return by_sweep.unionByName(_neighbour_links(shared.filter(F.col("n") > max_key_rows).select("fp").distinct(), radius))


def _flips(reach: int) -> list[int]:
    """Masks of up to ``reach`` bits, as signed longs."""
    return [reduce(lambda x, y: x ^ y, ((1 << b) - (1 << 64) if b == 63 else 1 << b for b in bits), 0) for n in range(reach + 1) for bits in combinations(range(64), n)]


def _neighbour_links(fps: DataFrame, radius: int) -> DataFrame:
    """The same links for ``fps`` of crowded keys, by the values near them: each row within half the radius (rounded up) of a
    value is linked with the smallest row within half the radius (rounded down) of it."""

    def near(reach: int) -> DataFrame:
        return fps.select("fp", F.explode(F.array(*map(F.lit, _flips(reach)))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))

    hubs = near(radius // 2).groupBy("value").agg(F.min("fp").alias("hub"))
    return near((radius + 1) // 2).join(hubs, "value").filter("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def _grouped(rows: DataFrame, radius: int, **options) -> DataFrame:
    """``rows`` (with fp and doc_id) with component_id: the smallest id that links of at most ``radius`` bits reach."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = connected_components(links(distinct.select("fp"), radius, **options))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"])
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    grouped = stored(rooted.join(named, "root").select("fp", "root", "component_id"), "grouped")
    alone = distinct.join(grouped, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least_id").alias("component_id"))
    return rows.join(grouped.unionByName(alone), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: the smallest id that links of at most ``radius`` bits reach."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    return _grouped(rows, radius, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, **options) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id, null last; of equal rows any one."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle_words, named=True), "fingerprints")
    return keep(docs, _grouped(rows, radius, **options).select(KEY, "doc_id", F.col("root").alias("component_id")))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
