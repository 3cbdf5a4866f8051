"""Alignment of two tokenizers over a corpus, with inverted bitmaps of token pairs.

Each text is encoded by both vocabularies. Where tokens of both end at the same byte the
text is cut into groups; an A and a B token whose bytes overlap are linked. Between two
neighbouring ends of either side lies exactly one linked pair, so links are read off the
merged ends, in linear time.

Documents are dealt with in blocks. A block inverts its documents: for every pair of ids
that is linked in it there is a bitmap of the documents that hold it, and, as a pair may be
linked several times in a document, bitmaps for the binary digits of the further links
(multiplicity planes). A bitmap is kept as its set bits (16 bits each) or as a row of bits,
whichever is smaller. Bitmaps of the parts of a block are ORed; those of different blocks
hold different documents, so the OR of a pair's bitmaps over the corpus is their union and
its population count the sum of theirs. That gives in how many documents a pair is linked
and, with the planes, how often. Only these counts are shuffled by pair. They go back to
each block along its list of pairs, where the bitmaps hand them out to the documents
(postings return scores): texts are encoded once, and links are never rows.

The vocabulary files are named by paths that every executor can open.

Defined cases: null and empty texts, and texts whose tokens of either side don't spell out
the text with a space before it, have no tokens and zeros; strings of special tokens are
plain text; rows with the same id count each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.storage import stored

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pair of ids is one number: that of A, then SIDE bits for that of B.
SIDE = 16
#: Documents and bytes of a part that is aligned at once; pairs of documents and token pairs, and documents, of a block.
PART_DOCS, PART_BYTES = 256, 2 << 20
BLOCK_ENTRIES, BLOCK_DOCS = 2_000_000, 1 << 16


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it can be printed, else the next ones from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """Encoding by a vocabulary: ids of texts, the bytes of each id, and their lengths."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.length = np.array([len(p) for p in pieces], np.int64)


@cache
def byte_side(path: str) -> Side:
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    letters, special = _byte_letters(), {t["content"] for t in vocabulary["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        pieces[i] = token
    return Side(lambda texts: [encoding.encode_ordinary(" " + t) for t in texts], pieces)


@cache
def piece_side(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Side(lambda texts: model.encode(texts, num_threads=1), pieces)


@cache
def _numerals(a: Side, b: Side) -> tuple[list[bytes], int]:
    """Ids of A with a comma, of A with a bar, of B with a comma, of B with a semicolon; and the size of A."""
    sides = ((len(a.pieces), b","), (len(a.pieces), b"|"), (len(b.pieces), b","), (len(b.pieces), b";"))
    return [b"%d%s" % (i, end) for n, end in sides for i in range(n)], len(a.pieces)


def _per(docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, minlength=n)


def aligned(texts: list[str | None], a: Side, b: Side) -> SimpleNamespace:
    """Of each text: n_a, n_b, n_groups, n_links, groups (bytes); and of all links: their text (doc) and pair of ids."""
    n = len(texts)
    some = [i for i, t in enumerate(texts) if t]
    full = [texts[i] for i in some]
    kept, ids_a, ids_b = [], [], []
    for i, text, x, y in zip(some, full, a.encode(full) if full else [], b.encode(full) if full else [], strict=True):
        want = b" " + text.encode()
        if b"".join(map(a.pieces.__getitem__, x)) == want and b"".join(map(b.pieces.__getitem__, y)) == want:
            kept.append(i)
            ids_a.append(np.array(x, np.int64))
            ids_b.append(np.array(y, np.int64))
    found = SimpleNamespace(n_a=np.zeros(n, np.int64), n_b=np.zeros(n, np.int64), n_groups=np.zeros(n, np.int64), n_links=np.zeros(n, np.int64), groups=[b""] * n, doc=np.zeros(0, np.int64), pair=np.zeros(0, np.int64))
    if not kept:
        return found
    at = np.array(kept)
    found.n_a[at], found.n_b[at] = [len(x) for x in ids_a], [len(x) for x in ids_b]
    all_a, all_b = np.concatenate(ids_a), np.concatenate(ids_b)
    doc_a, doc_b = np.repeat(at, found.n_a[at]), np.repeat(at, found.n_b[at])
    ends_a, ends_b = np.cumsum(a.length[all_a]), np.cumsum(b.length[all_b])  # both reach the texts' ends together
    marks_a, marks_b = np.zeros(int(ends_a[-1]) + 1, np.int64), np.zeros(int(ends_a[-1]) + 1, np.int64)
    marks_a[ends_a] = 1
    marks_b[ends_b] = 1

    ends = np.flatnonzero(marks_a | marks_b)
    link_a, link_b = (np.cumsum(m)[ends] - m[ends] for m in (marks_a, marks_b))
    found.doc = doc_a[link_a]
    found.pair = (all_a[link_a] << SIDE) | all_b[link_b]
    found.n_links = _per(found.doc, n)

    shared = marks_a & marks_b
    cuts = np.cumsum(shared)
    found.n_groups = _per(doc_a[shared[ends_a] > 0], n)
    last_a, last_b = shared[ends_a] > 0, shared[ends_b] > 0
    group_a, group_b = cuts[ends_a] - last_a, cuts[ends_b] - last_b
    in_a, in_b = _per(group_a, int(cuts[-1])), _per(group_b, int(cuts[-1]))
    numerals, size = _numerals(a, b)
    order = np.empty(len(all_a) + len(all_b), np.int64)
    order[np.arange(len(all_a)) + (np.cumsum(in_b) - in_b)[group_a]] = all_a + size * last_a
    order[np.arange(len(all_b)) + np.cumsum(in_a)[group_b]] = 2 * size + all_b + len(b.pieces) * last_b
    spelt = list(map(numerals.__getitem__, order.tolist()))
    start = 0
    for i in kept:
        stop = start + int(found.n_a[i] + found.n_b[i])
        found.groups[i] = b"".join(spelt[start:stop])[:-1]
        start = stop
    return found


def packed(index: np.ndarray, doc: np.ndarray, sizes: np.ndarray, n_docs: int) -> tuple[bytes, bytes]:
    """Bitmaps over ``n_docs`` documents, of which ``sizes[i]`` are set in bitmap i: rows of bits, and the set bits of the others."""
    dense = sizes * 16 > n_docs
    row = np.cumsum(dense) - 1
    on = dense[index]
    bits = np.zeros((int(dense.sum()), n_docs), bool)
    bits[row[index[on]], doc[on]] = True
    return np.packbits(bits, axis=1).tobytes(), doc[~on].astype("<u2").tobytes()


def unpacked(sizes: np.ndarray, n_docs: int, bits: bytes, rest: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, document) of every set bit of ``packed``."""
    dense = sizes * 16 > n_docs
    rows = np.frombuffer(bits, np.uint8).reshape(int(dense.sum()), -(-n_docs // 8))
    which, doc = np.nonzero(np.unpackbits(rows, axis=1, count=n_docs)) if len(rows) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    few = np.repeat(np.flatnonzero(~dense), sizes[~dense])
    return np.concatenate([np.flatnonzero(dense)[which], few]), np.concatenate([doc, np.frombuffer(rest, "<u2").astype(np.int64)])


PLANE = "struct<sizes:binary,bits:binary,rest:binary>"


def inverted(entries: np.ndarray, times: np.ndarray, n_docs: int) -> dict:
    """The bitmaps of a block from (pair of ids, document) entries, each once, and how often each is linked.

    pairs in ascending order, the documents and links of each, and planes: that of the documents, then those of the binary
    digits of how often a pair is linked beyond once.
    """
    order = np.argsort(entries)
    entries, more = entries[order], times[order] - 1
    pair, doc = entries >> 16, entries & 0xFFFF
    first = np.concatenate(([True], pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, bool)
    index, n = np.cumsum(first) - 1, int(first.sum())
    planes, links = [], np.zeros(n, np.int64)
    for digit in range(-1, int(more.max(initial=0)).bit_length()):
        on = np.ones(len(more), bool) if digit < 0 else (more >> digit) & 1 > 0
        sizes = _per(index[on], n)
        links += sizes << max(digit, 0)
        bits, rest = packed(index[on], doc[on], sizes, n_docs)
        planes.append({"sizes": sizes.astype("<u4").tobytes(), "bits": bits, "rest": rest})
    return {"pairs": pair[first], "docs": _per(index, n), "links": links, "planes": planes}


def handed_out(planes: list[dict], values: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document the sum of its pairs' values (a row each of ``values``), as often as they are linked."""
    total = np.zeros((n_docs, values.shape[1]), np.int64)
    for number, plane in enumerate(planes):
        which, doc = unpacked(np.frombuffer(plane["sizes"], "<u4").astype(np.int64), n_docs, plane["bits"], plane["rest"])
        for c in range(values.shape[1]):
            np.add.at(total[:, c], doc, values[which, c] << max(number - 1, 0))
    return total


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Stored blocks: their documents with counts and the hash of their groups, and the inverted bitmaps of their pairs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    document = "doc_id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string".format(kind)
    names = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_side(byte_bpe), piece_side(piece_bpe)
        number, held, n_docs, n_entries = TaskContext.get().partitionId() << 32, [], 0, 0
        types: list[pa.DataType] = []

        def parts() -> Iterator[tuple[pa.Array, list]]:
            for batch in batches:
                if not types:
                    types.append(batch.schema.field("doc_id").type)
                texts, begin, size = [], 0, 0
                for i in range(batch.num_rows):
                    texts.append(batch.column(1)[i].as_py())
                    size += len(texts[-1] or "")
                    if len(texts) == PART_DOCS or size > PART_BYTES or i + 1 == batch.num_rows:
                        yield batch.column(0).slice(begin, len(texts)), texts
                        begin, texts, size = i + 1, [], 0

        def block() -> pa.RecordBatch:
            maps = inverted(np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), n_docs)
            fields = [pa.field("doc_id", types[0]), *(pa.field(n, pa.int64()) for n in names), pa.field("groups_sha256", pa.string())]
            columns = [pa.concat_arrays([h[0] for h in held]), *(pa.array(np.concatenate([getattr(h[1], n) for h in held])) for n in names), pa.array([x for h in held for x in h[1].groups])]
            documents = pa.StructArray.from_arrays(columns, fields=fields)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            plane = pa.list_(pa.struct([("sizes", pa.binary()), ("bits", pa.binary()), ("rest", pa.binary())]))
            arrays = [pa.array([number], pa.int64()), one(documents), *(one(pa.array(maps[n])) for n in ("pairs", "docs", "links")), pa.array([maps["planes"]], plane)]
            return pa.RecordBatch.from_arrays(arrays, ["block", "documents", "pairs", "docs", "links", "planes"])

        for ids, texts in parts():
            if n_docs + len(texts) > BLOCK_DOCS or n_entries > block_entries:
                yield block()
                number, held, n_docs, n_entries = number + 1, [], 0, 0
            found = aligned(texts, a, b)
            found.groups = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups]
            entries, times = np.unique((found.pair << 16) | (found.doc + n_docs), return_counts=True)
            found.doc = found.pair = None
            held.append((ids, found, entries, times))
            n_docs, n_entries = n_docs + len(texts), n_entries + len(entries)
        if held:
            yield block()

    return stored(rows.mapInArrow(run, f"block bigint, documents array<struct<{document.replace(' ', ':').replace(',:', ',')}>>, pairs array<bigint>, docs array<bigint>, links array<bigint>, planes array<{PLANE}>"), "blocks")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, a, b, docs, links): in how many documents of the corpus ids a and b are linked, and how often, from ``blocks``."""
    each = found.select(F.explode(F.arrays_zip("pairs", "docs", "links")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("docs"), F.sum("p.links").alias("links"))
    return counts.select("pair", F.shiftright("pair", SIDE).alias("a"), (F.col("pair") % (1 << SIDE)).alias("b"), "docs", "links")


def scored(found: DataFrame, value: list[Column], names: list[str]) -> DataFrame:
    """The documents of ``blocks``, each with the sums, over its links, of values of the links' pairs.

    ``value`` are columns of ``pair_counts`` (whole numbers, and windows over an id of A, whose pairs are as many as B has
    ids at most).
    """
    counts = pair_counts(found).select("pair", F.array(*[v.cast("bigint") for v in value]).alias("value"))
    asked = found.select("block", F.posexplode("pairs").alias("at", "pair"))
    lists = asked.join(counts, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("found"))
    rows = found.select("block", "documents", "planes").join(lists.select("block", F.flatten("found.value").alias("values")), "block", "left")
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                documents = batch.column(1)[i].values
                values = np.array(batch.column(3)[i].values or [], np.int64).reshape(-1, width)
                total = handed_out(batch.column(2)[i].as_py(), values, len(documents))
                yield pa.RecordBatch.from_arrays([*documents.flatten(), *(pa.array(total[:, c]) for c in range(width))], [*(f.name for f in documents.type), *names])

    fields = kinds["documents"].removeprefix("array<struct<").removesuffix(">>").replace(":", " ")
    return rows.mapInArrow(run, fields + "".join(f", {n} bigint" for n in names))


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    found = blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.col("docs") == F.max("docs").over(W.partitionBy("a"))
    return scored(found, [best.cast("int"), F.col("docs")], ["n_best", "count_sum"])
