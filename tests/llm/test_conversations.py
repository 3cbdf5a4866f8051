"""Repair of conversations against all edit scripts in plain Python, and against SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from tidewell.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, extra int"
WHITE = " \t\n\x0b\x0c\r"


def hurt(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        mark = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if mark == 1:
            text = ""
        if mark == 2:
            text = "".join(x for x in text if x not in ".!?")
        out += [(c, t, "user" if mark == 4 else role, text)] * (0 if mark == 0 else 2 if mark == 3 else 1)
    return out


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's rows: the least script by (cost, script)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, script, said) in list(best.items()):
                for i in follow[state]:
                    if i in names:
                        new = (cost + 2, script + "I", said + [f"{names[i]}:"])
                        best[i] = min(best.get(i, new), new)
        return best

    best = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, script, said) in inserted(best).items():
            ways = [(state, (cost + 3, script + "D", said))]
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] in follow[state] and role:
                    ways.append((role[:1], (cost + late, script + "K", said + [f"{role}:{text}"])))
                ways += [(i, (cost + 2 + late, script + "R", said + [f"{names[i]}:{text}"])) for i in follow[state] if i in names]
            for i, new in ways:
                after[i] = min(after.get(i, new), new)
        best = after
    cost, script, said = min(v for k, v in inserted(best).items() if k in ("", "a"))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, script, hashlib.sha256("\n".join(said).encode()).hexdigest())


def expected(rows):
    ids = {r[0] for r in rows}
    bad = hurt([r[:4] for r in rows])
    return sorted([(c, *brute([r for r in bad if r[0] == c])) for c in ids], key=str)


def odd_rows(seed, n):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ux", "\U0001f600"]
    texts = ["Yes.", "No", "a? ", " \n", "", None, "é.", "Well!", "x" * 300, "Yes.\t"]
    rows = [(rnd.choice([*range(n // 8), None]), rnd.choice([None, *range(-3, 9), 10**12]), rnd.choice(roles), rnd.choice(texts), 1) for _ in range(n)]
    for c in range(1000, 1000 + n // 6):  # mostly sound ones, some rows repeated
        for t in range(rnd.randrange(1, 9)):
            rows += [(c, t, "system" if t == 0 and rnd.random() < 0.3 else roles[(t + (rnd.random() < 0.1)) % 2], f"{t} {rnd.choice(texts)}.", 1)] * (1 + (rnd.random() < 0.05))
    return rows


@pytest.mark.parametrize("piece_bytes", [conv.PIECE_BYTES, 200])
def test_against_all_scripts(spark, piece_bytes):
    rows = odd_rows(piece_bytes, 600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = conv.digests(conv.repaired(conv.damaged(df), piece_bytes)).collect()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == expected(rows)


def test_one_long_conversation(spark):
    """A conversation over many pieces and partitions, with a row repeated thousands of times."""
    rnd = random.Random(3)
    rows = [(7, t, rnd.choice(["user", "assistant", "system"]), f"text {rnd.randrange(400)}{rnd.choice('. ,')}", 1) for t in range(1500)]
    rows += [(7, None, "user", "again.", 1)] * 3000 + [(8, 0, "user", "a.", 1), (8, 1, "assistant", "b.", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    fixed = conv.repaired(conv.damaged(df), 2000)
    assert fixed.filter("conv_id = 7").count() > 20
    got = conv.digests(fixed).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(c, *x[:6], *x[6:]) for c, *x in expected(rows)], key=str)
    said = [(m.role, m.text) for r in fixed.filter("conv_id = 8").orderBy("piece").collect() for m in r.messages]
    assert said and len(said) % 2 == 0 and all(role in ("user", "assistant") for role, _ in said)


def test_blocks_equal_single_steps():
    """Looking up a block gives what its rows give one by one, for every vector and state; few vectors occur."""
    t = conv.tables()
    assert t.vectors < 60
    rnd = np.random.default_rng(1)
    symbols = [rnd.integers(1, conv.SYMBOLS, n) for n in (0, 1, 3, 4, 5, 17, 64)]
    vector, leave = conv.summaries(symbols)
    for i, mine in enumerate(symbols):
        for v in range(t.vectors):
            at, states = v, list(range(4))
            behind = []
            for s in mine[::-1]:
                behind.append(at)
                at = int(t.begin[s, at])
            for s, b in zip(mine, behind[::-1], strict=True):
                states = [int(t.leave[s, b, q]) for q in states]
            assert vector[i, v] == at and leave[i, v].tolist() == states


def test_sql_and_empty(spark, tmp_path):
    rows = odd_rows(5, 200)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = conv.op11_conversation_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(conv.ORACLE_SQL).select(", ".join(got.columns)).fetchall(), key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert conv.digests(conv.repaired(conv.damaged(empty))).count() == 0
