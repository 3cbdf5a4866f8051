"""Repair of the structure of conversations by least-cost edits, with block tables.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``: a system row at
most, then user and assistant in turn. Rows are kept (cost 0), given the role that is due
(2) or deleted (3; blank and repeated rows have to go), empty rows of the role that is due
may come in anywhere (2), and a truncated row that stays costs 1 more. Of the cheapest
edits, that whose initials (D, I, K, R) come first in ASCII is taken.

The method is that of the four Russians. How much it costs to finish from each of the
pattern's four states is a vector; less its minimum, it takes a few values only, as no
state is ever more than a few edits from another. So a table holds, for every block of
BLOCK symbols (a symbol is a row's role, fault and whether it is truncated) and every
such vector after it, the vector before it and the state in which each entering state
leaves. A conversation is read from its end by one lookup a block; then every block is
expanded backward into the vectors between its rows, which tell the first of the cheapest
edits, ties included, from the entering state on.

Rows are sorted into pieces of bounded size, so no conversation is one task's: a piece is
itself such a table row (vector after it to vector before it, state to state), pieces are
composed per conversation from these few numbers, and each is traced on its own. Equal
rows of a turn are one row with a number of copies. Only the digest reads a conversation's
pieces in order in one task, as a hash over all of it must, a piece at a time.

Defined cases: null roles and texts are one space; a null turn comes before all others;
rows of equal turns are taken by role and text; a conversation without rows (``copies`` of
0 on all) has counts of zero and no edits; null conversation ids are one conversation; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import count, groupby
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.storage import stored

#: States of the pattern: nothing yet, after a system row, after a user's, after an answer. The first and the last may end.
START, SYSTEM, USER, REPLY = range(4)
#: The role that is due in each state, the state after it, and the state after a kept role (by initial; others can't stay).
DUE = ("user", "user", "assistant", "user")
AFTER_DUE = (USER, USER, REPLY, USER)
INITIALS = "sua"
AFTER_KEPT = ({0: SYSTEM, 1: USER}, {1: USER}, {2: REPLY}, {1: USER})
#: Costs of edits; a truncated row that stays costs one more.
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
#: Symbols: none (fills a block), a row that has to go, sound rows by initial, truncated rows by initial.
FILL, GONE, SOUND, TRUNCATED, SYMBOLS = 0, 1, 2, 6, 10
BLOCK = 4
WHITE = " \t\n\x0b\x0c\r"
#: Bytes of a piece: its texts and so many a row. Rows of a batch of pieces.
PIECE_BYTES, ROW_BYTES, BATCH = 4 << 20, 64, 256

Vector = tuple[int, int, int, int]


def _step(after: Vector, symbol: int) -> tuple[Vector, list[tuple[str, int]]]:
    """The costs to finish before a row, by state, and each state's first edits up to and with the row and the state after them."""
    if symbol == FILL:
        return after, [("", q) for q in range(4)]
    more = int(symbol >= TRUNCATED)
    ways: list[dict[str, tuple[int, int]]] = []
    for q in range(4):
        ways.append({"D": (COST["D"] + after[q], q)})
        if symbol != GONE:
            ways[q]["R"] = (COST["R"] + more + after[AFTER_DUE[q]], AFTER_DUE[q])
            kept = AFTER_KEPT[q].get((symbol - SOUND) % 4)
            if kept is not None:
                ways[q]["K"] = (COST["K"] + more + after[kept], kept)
    least = [min(cost for cost, _ in w.values()) for w in ways]
    for _ in range(2):  # no more than two rows come in before a row
        least = [min(least[q], COST["I"] + least[AFTER_DUE[q]]) for q in range(4)]

    def first(q: int) -> tuple[str, int]:
        if ways[q]["D"][0] == least[q]:
            return "D", ways[q]["D"][1]
        if COST["I"] + least[AFTER_DUE[q]] == least[q]:
            edits, out = first(AFTER_DUE[q])
            return "I" + edits, out
        edit = min(e for e, (cost, _) in ways[q].items() if cost == least[q])
        return edit, ways[q][edit][1]

    return (least[0], least[1], least[2], least[3]), [first(q) for q in range(4)]


#: What it costs to finish when no row is left, and the edits that do.
FINAL: Vector = (0, 4, 2, 0)
FINISH = ("", "II", "I", "")


@cache
def tables() -> SimpleNamespace:
    """The steps of single rows over all vectors that occur, and those of blocks, composed from them."""
    ids: dict[Vector, int] = {FINAL: 0}
    steps: dict[tuple[int, int], tuple[int, list[tuple[str, int]]]] = {}
    waiting = [FINAL]
    while waiting:
        after = waiting.pop()
        for symbol in range(SYMBOLS):
            before, moves = _step(after, symbol)
            norm: Vector = tuple(c - min(before) for c in before)  # type: ignore[assignment]
            if norm not in ids:
                ids[norm] = len(ids)
                waiting.append(norm)
            steps[symbol, ids[after]] = ids[norm], moves
    edits = sorted({e for _, moves in steps.values() for e, _ in moves})
    begin = np.zeros((SYMBOLS, len(ids)), np.int16)
    leave = np.zeros((SYMBOLS, len(ids), 4), np.int8)
    edit = np.zeros((SYMBOLS, len(ids), 4), np.int16)
    for (symbol, v), (norm_id, moves) in steps.items():
        begin[symbol, v] = norm_id
        leave[symbol, v] = [q for _, q in moves]
        edit[symbol, v] = [edits.index(e) for e, _ in moves]
    block_begin = np.arange(len(ids), dtype=np.int16)[None]
    block_leave = np.broadcast_to(np.arange(4, dtype=np.int8), (1, len(ids), 4))
    for _ in range(BLOCK):  # a symbol in front of every block so far
        fronts = leave[:, block_begin]
        block_leave = np.stack([np.take_along_axis(block_leave, f.astype(np.int64), axis=2) for f in fronts]).reshape(-1, len(ids), 4)
        block_begin = begin[:, block_begin].reshape(-1, len(ids))
    return SimpleNamespace(begin=begin, leave=leave, edit=edit, edits=edits, block_begin=block_begin, block_leave=block_leave, vectors=len(ids))


def _blocks(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all sequences one after another, as rows of symbols, with each one's first block and number of blocks."""
    sizes = np.array([-(-len(s) // BLOCK) for s in symbols], np.int64)
    flat = np.zeros(int(sizes.sum()) * BLOCK, np.int64)
    starts = np.cumsum(sizes) - sizes
    for s, at in zip(symbols, (starts * BLOCK).tolist(), strict=True):
        flat[at : at + len(s)] = s
    return flat.reshape(-1, BLOCK), starts, sizes


def _number(blocks: np.ndarray) -> np.ndarray:
    return blocks @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def summaries(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each sequence, for every vector after it: the vector before it, and the state in which each state leaves."""
    t = tables()
    blocks, starts, sizes = _blocks(symbols)
    number = _number(blocks)
    vector = np.broadcast_to(np.arange(t.vectors), (len(symbols), t.vectors)).copy()
    leave = np.broadcast_to(np.arange(4), (len(symbols), t.vectors, 4)).copy()
    for j in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > j)
        block = number[starts[on] + sizes[on] - 1 - j][:, None]
        leave[on] = np.take_along_axis(leave[on], t.block_leave[block, vector[on]].astype(np.int64), axis=2)
        vector[on] = t.block_begin[block, vector[on]]
    return vector, leave


def traced(symbols: list[np.ndarray], after: np.ndarray, entering: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each sequence: the number (in ``tables().edits``) of the edits up to and with each row, and the state in which it leaves."""
    t = tables()
    blocks, starts, sizes = _blocks(symbols)
    number = _number(blocks)
    behind, state_at = np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int64)
    vector, state = after.astype(np.int64), entering.astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    active = [int(np.searchsorted(-sizes[order], -j, side="left")) for j in range(int(sizes.max(initial=0)))]
    for j, n in enumerate(active):
        on = order[:n]
        at = starts[on] + sizes[on] - 1 - j
        behind[at] = vector[on]
        vector[on] = t.block_begin[number[at], vector[on]]
    for j, n in enumerate(active):
        on = order[:n]
        at = starts[on] + j
        state_at[at] = state[on]
        state[on] = t.block_leave[number[at], behind[at], state[on]]
    inside = np.empty(blocks.shape, np.int64)  # the vector after each row, backward through every block at once
    for i in range(BLOCK - 1, -1, -1):
        inside[:, i] = behind
        behind = t.begin[blocks[:, i], behind].astype(np.int64)
    edits = np.empty(blocks.shape, np.int64)
    for i in range(BLOCK):
        edits[:, i] = t.edit[blocks[:, i], inside[:, i], state_at]
        state_at = t.leave[blocks[:, i], inside[:, i], state_at].astype(np.int64)
    flat = edits.reshape(-1)
    return [flat[a : a + len(s)] for s, a in zip(symbols, (starts * BLOCK).tolist(), strict=True)], state


def _named(*columns: str) -> Column:
    """A key that rows share only if they are equal in the columns; null differs from all strings."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.md5(F.col(c).cast("string")), F.lit("~")) for c in columns]))


def faulted(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, blank, truncated, earlier) of rows (conv_id, turn, role, text, copies), equal rows as one.

    ``earlier`` says that the role and the text have been seen before this turn of the conversation. Repeats are found by
    counts per conversation, role and text, so neither a long conversation nor a frequent text is gathered.
    """
    space = {c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")}
    turns = rows.withColumns(space).groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    turns = turns.withColumn("blank", body == "").withColumn("truncated", ~F.substring(body, -1, 1).isin(".", "!", "?"))
    turns = stored(turns.withColumn("name", _named("conv_id", "role", "text")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = turns.filter("copies > 0 AND NOT blank").groupBy("name").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    marked = turns.join(said.filter("n > 1").select("name", "first"), "name", "left")
    return marked.withColumn("earlier", F.coalesce(place > F.col("first"), F.lit(False))).drop("name", "first")


def _types(rows: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in rows.schema.fields}


def pieces(rows: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Stored pieces of conversations, in the order of ``piece``: symbols, roles and texts of their rows, and counts."""
    kinds = _types(rows)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    ordered = rows.repartitionByRange(parts, *order, F.substring("text", 1, 24)).sortWithinPartitions(*order, "text")
    ordered = ordered.select("conv_id", "turn", "role", "text", "copies", "blank", "truncated", "earlier")
    fields = f"conv_id {kinds['conv_id']}, piece bigint, symbols binary, row_of array<int>, roles array<string>, texts array<string>, turns array<{kinds['turn']}>, blank bigint, duplicate bigint, truncated bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 40)
        schema, held, size = None, [], 0

        def piece(rows: list[tuple]) -> dict:
            symbols, row_of, counts = [], [], [0, 0, 0]
            for i, (_, _, role, _, copies, blank, truncated, earlier) in enumerate(rows):
                initial = INITIALS.find(role[:1]) if role else -1
                sound = (TRUNCATED if truncated else SOUND) + (3 if initial < 0 else initial)
                stays = int(not blank and not earlier)
                symbols += [sound] * stays + [GONE] * (copies - stays)
                row_of += [i] * copies
                counts[0] += copies if blank else 0
                counts[1] += 0 if blank else copies - stays
                counts[2] += stays * truncated
            return {"conv_id": rows[0][0], "piece": next(number), "symbols": bytes(symbols), "row_of": row_of, "roles": [r[2] for r in rows], "texts": [r[3] for r in rows], "turns": [r[1] for r in rows], "blank": counts[0], "duplicate": counts[1], "truncated": counts[2]}

        def batch_of(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(found, schema=schema)

        ready: list[dict] = []
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("piece", pa.int64()), ("symbols", pa.binary()), ("row_of", pa.list_(pa.int32())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turns", pa.list_(batch.schema.field("turn").type)), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64())])
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != row[0] or size > piece_bytes):
                    ready.append(piece(held))
                    held, size = [], 0
                    if len(ready) >= BATCH:
                        yield batch_of(ready)
                        ready = []
                if row[4] > 0 or not held:  # a conversation's dropped rows leave its id
                    if held and held[0][4] == 0:
                        held = []
                    held.append(row)
                    size += len(row[3]) + ROW_BYTES * (1 + row[4])
            if sum(sum(map(len, p["texts"])) for p in ready) > piece_bytes:
                yield batch_of(ready)
                ready = []
        if held:
            ready.append(piece(held))
        if ready:
            yield batch_of(ready)

    return stored(ordered.mapInArrow(run, fields), "pieces")


def _placed(cut: DataFrame) -> DataFrame:
    """(piece, after, entering, last) of the pieces of conversations that have several: composed from the pieces' summaries."""
    several = cut.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_c"))
    mine = cut.select("conv_id", "piece", "symbols").join(several, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector, leave = summaries([np.frombuffer(s.as_py(), np.uint8) for s in batch.column("symbols")])
            tables_of = [(v.astype(np.uint8).tobytes(), x.astype(np.uint8).tobytes()) for v, x in zip(vector, leave, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), *(pa.array([x[i] for x in tables_of], pa.binary()) for i in (0, 1))], ["conv_id", "piece", "vector", "leave"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int, bool]] = []
            for parts in batch.column("parts").to_pylist():
                after, behind = 0, []
                for p in reversed(parts):
                    behind.append(after)
                    after = p["vector"][after]
                state = START
                for p, v in zip(parts, reversed(behind), strict=True):
                    found.append((p["piece"], v, state, p is parts[-1]))
                    state = p["leave"][4 * v + state]
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*found)], ["piece", "after", "entering", "last"])

    kind = _types(cut)["conv_id"]
    each = mine.mapInArrow(summed, f"conv_id {kind}, piece bigint, vector binary, leave binary")
    lists = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "vector", "leave"))).alias("parts"))
    return lists.select("parts").mapInArrow(composed, "piece bigint, after bigint, entering bigint, last boolean")


def repaired(rows: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A row for each piece of each conversation, in the order of ``piece``, from rows (conv_id, turn, role, text, copies).

    conv_id, piece, messages (array of role, text: the sound conversation), audit, cost, and counts of faults; turns and
    initials (of all rows, repaired or not) serve the counts that reach over pieces.
    """
    cut = pieces(faulted(rows), piece_bytes)
    kinds = _types(cut)
    placed = cut.join(_placed(cut), "piece", "left")
    placed = placed.withColumns({"after": F.coalesce("after", F.lit(0)), "entering": F.coalesce("entering", F.lit(START)), "last": F.coalesce("last", F.lit(True))})
    names = ["conv_id", "piece", "turns", "blank", "duplicate", "truncated", "symbols", "row_of", "roles", "texts", "after", "entering", "last"]
    kept = names[:6]
    message = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for batch in batches:
            c = {n: batch.column(n) for n in names}
            symbols = [np.frombuffer(s.as_py(), np.uint8) for s in c["symbols"]]
            edits, leaving = traced(symbols, c["after"].to_numpy(), c["entering"].to_numpy())
            out: dict[str, list] = {"messages": [], "audit": [], "cost": [], "initials": []}
            for i, mine in enumerate(edits):
                state, said, audit, cost = c["entering"][i].as_py(), [], [], 0
                roles, texts, row_of = c["roles"][i].as_py(), c["texts"][i].as_py(), c["row_of"][i].as_py()
                for number, row, symbol in zip(mine.tolist(), row_of, symbols[i].tolist(), strict=True):
                    for edit in t.edits[number]:
                        cost += COST[edit] + (edit in "KR" and symbol >= TRUNCATED)
                        if edit == "K":
                            said.append((roles[row], texts[row]))
                            state = AFTER_KEPT[state][(symbol - SOUND) % 4]
                        elif edit != "D":
                            said.append((DUE[state], texts[row] if edit == "R" else ""))
                            state = AFTER_DUE[state]
                    audit.append(t.edits[number])
                if c["last"][i].as_py():
                    for edit in FINISH[leaving[i]]:
                        said.append((DUE[state], ""))
                        state, cost = AFTER_DUE[state], cost + COST[edit]
                        audit.append(edit)
                out["messages"].append([{"role": r, "text": x} for r, x in said])
                out["audit"].append("".join(audit))
                out["cost"].append(cost)
                out["initials"].append("".join(roles[r][:1] or "-" for r in row_of))
            arrays = [pa.array(out["messages"], pa.list_(message)), pa.array(out["audit"], pa.string()), pa.array(out["cost"], pa.int64()), pa.array(out["initials"], pa.string())]
            yield pa.RecordBatch.from_arrays([*(c[n] for n in kept), *arrays], [*kept, *out])

    found = "messages array<struct<role:string,text:string>>, audit string, cost bigint, initials string"
    return placed.select(*names).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in kept) + ", " + found)


def digests(fixed: DataFrame) -> DataFrame:
    """A row for each conversation of ``repaired``: its counts, edits and the hash of its messages.

    A conversation's pieces are read in their order, one at a time: what is held of those before is the hash's state, the
    edits so far and a few numbers.
    """
    kind = _types(fixed)["conv_id"]
    counted = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    known = F.filter("turns", lambda x: x.isNotNull())
    pair = F.regexp_count("initials", F.lit("s(?!u)|u(?!a)|a(?!u)|[^sua]"))  # wrong with what follows, the last row of the piece included
    rows = fixed.select("conv_id", "piece", "blank", "duplicate", "truncated", "cost", "audit", F.size("messages").alias("n"), text.alias("text"), F.array_min(known).cast("bigint").alias("low"), F.array_max(known).cast("bigint").alias("high"), F.size(F.array_distinct(known)).alias("turns"), "initials", pair.alias("wrong"))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "piece")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []

        def batch_of() -> pa.RecordBatch:
            names = ["conv_id", *counted]
            return pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], pa.int64() if n != "conv_id" else id_type[0]) for n in names] + [pa.array([d[n] for d in done], pa.string()) for n in ("audit", "repaired_sha256")], [*names, "audit", "repaired_sha256"])

        id_type: list = []

        def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not id_type:
                    id_type.append(batch.schema.field("conv_id").type)
                yield batch

        for conv, parts in groupby(read(noted(batches)), key=lambda r: r["conv_id"]):
            total, audit, hashed, some = dict.fromkeys(counted, 0) | {"conv_id": conv}, [], hashlib.sha256(), False
            low = high = None
            turns, before = 0, ""
            for p in parts:
                for n in ("blank", "duplicate", "truncated", "cost"):
                    total[n] += p[n]
                audit.append(p["audit"])
                if p["n"]:
                    hashed.update((("\n" if some else "") + p["text"]).encode("utf-8", "surrogatepass"))
                    some = True
                if p["turns"]:
                    turns += p["turns"] - (high == p["low"])
                    low, high = p["low"] if low is None else low, p["high"]
                if p["initials"]:
                    total["illegal"] += p["wrong"] - (before + p["initials"][0] in ("su", "ua", "au"))
                    before = p["initials"][-1]
            total["illegal"] -= bool(before)  # nothing follows the last row
            total["gaps"] = high - low + 1 - turns if turns else 0
            done.append(total | {"audit": "".join(audit), "repaired_sha256": hashed.hexdigest()})
            if len(done) >= 1024:
                yield batch_of()
                done = []
        if done:
            yield batch_of()

    return rows.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{n} bigint" for n in counted) + ", audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage by the checksum of ``conv_id:turn``: rows (conv_id, turn, role, text, copies)."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), mark.alias("mark"))
    text = F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("mark") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("mark") == 0, 0).when(F.col("mark") == 3, 2).otherwise(1)
    gone = F.col("copies") == 0
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(F.col("text")).alias("text"), "copies")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return digests(repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def _oracle() -> str:
    """DuckDB SQL with the same rows: the pattern's four states forward, row by row, with the least (cost, edits) of each."""

    def grown(state: str, edit: str, said: str | None, more: str = "0") -> str:
        kept = f"list_append({state}.said, {said})" if said else f"{state}.said"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'cost': {state}.cost + {COST[edit]} + {more}, 'audit': {state}.audit || '{edit}', 'said': {kept}}} END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN fault <> 'gone' AND substr(role, 1, 1) = '{initial}' THEN {grown(state, 'K', "role || ':' || text", 'late')} END"

    def given(state: str, role: str) -> str:
        return f"CASE WHEN fault <> 'gone' THEN {grown(state, 'R', f"'{role}:' || text", 'late')} END"

    into_user = least("s2", *[grown(s, "I", "'user:'") for s in ("s0", "s1", "s3")])
    into_reply = least("s3", grown("su", "I", "'assistant:'"))
    none = "CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[]))"
    begin = "CAST({'cost': 0, 'audit': '', 'said': []} AS STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[]))"
    return f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)),
marked AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS mark FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE mark WHEN 4 THEN 'user' ELSE role END AS role, CASE mark WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE mark WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, substr(role, 1, 1) AS initial FROM placed),
judged AS (SELECT *, final = '' AS blank, final <> '' AND nth > 1 AS duplicate, final <> '' AND nth = 1 AND final NOT IN ('.', '!', '?') AS truncated,
  coalesce(lag(initial) OVER w || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
rows AS (SELECT conv_id, pos, role, text, truncated::INT AS late, CASE WHEN blank OR duplicate THEN 'gone' ELSE 'stays' END AS fault FROM judged),
ids AS (SELECT conv_id, count(*) FILTER (pos IS NOT NULL) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM (SELECT conv_id, turn, pos, blank, duplicate, truncated, illegal FROM judged UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, NULL, NULL, NULL FROM conversations) GROUP BY conv_id),
steps AS (
  SELECT conv_id, n, 0 AS pos, {begin} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM ids
  UNION ALL
  SELECT conv_id, n, pos, {grown('s0', 'D', None)}, {least(grown('s1', 'D', None), kept('s0', 's'))},
    {least(grown('su', 'D', None), *[f(s, x) for s in ('s0', 's1', 'sr') for f, x in ((kept, 'u'), (given, 'user'))])},
    {least(grown('sr', 'D', None), kept('su', 'a'), given('su', 'assistant'))}
  FROM (SELECT *, {into_reply} AS sr FROM (SELECT steps.conv_id, n, rows.pos, role, text, late, fault, s0, s1, s3, {into_user} AS su FROM steps JOIN rows ON steps.conv_id IS NOT DISTINCT FROM rows.conv_id AND rows.pos = steps.pos + 1))),
ends AS (SELECT conv_id, {least('s0', into_reply)} AS best FROM (SELECT conv_id, s0, s3, {into_user} AS su FROM steps WHERE pos = n))
SELECT ids.conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.said, chr(10))) AS repaired_sha256
FROM ids JOIN ends ON ids.conv_id IS NOT DISTINCT FROM ends.conv_id"""


ORACLE_SQL = _oracle()
