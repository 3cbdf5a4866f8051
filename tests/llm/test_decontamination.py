from __future__ import annotations

import random
from collections import Counter

import pytest

from tidewell.llm import decontamination as D


def brute(docs, items, similarity=0.8, k=5):
    def shingles(w):
        return Counter(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))

    classes = {}
    for item, text in items:
        if w := tuple((text or "").lower().split()):
            classes.setdefault(w, []).append(item)
    found = set()
    for doc, text in docs:
        w = (text or "").lower().split()
        for iw, ids in classes.items():
            name = (min((i for i in ids if i is not None), default=None), len(ids))
            if len(iw) < k:
                if tuple(w) == iw:
                    found.add((doc, *name, 1.0, 0, len(w)))
                continue
            target, best = shingles(iw), None
            if not shingles(w).keys() & target.keys():
                continue
            for s in range(max(len(w) - len(iw), 0) + 1):
                part = w[s : s + len(iw)]
                have = shingles(part)
                both = sum((have & target).values())
                sim = both / (sum(have.values()) + sum(target.values()) - both) if have else 0.0
                if sim >= similarity and (best is None or sim > best[0]):
                    best = (sim, s, len(part))
            if best:
                found.add((doc, *name, *best))
    return found


def tables(seed=0):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([4, 5, 7, 20, 40, 60])))) for i in range(12)]
    items += [(50, items[3][1]), (None, items[3][1]), (None, "only null id here we go"), (60, None), (61, "  "), (62, "la la la la la la la la la la la la")]
    docs = []
    for d in range(60):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(80))]
        for _ in range(rnd.randrange(3)):
            part = list(rnd.choice(items)[1].split() if rnd.random() < 0.95 else []) if (item := rnd.choice(items))[1] is None else item[1].split()
            for _ in range(rnd.choice([0, 0, 0, 1, 2, 3])):
                if part:
                    at = rnd.randrange(len(part))
                    part[at : at + rnd.randrange(2)] = rnd.choice([[], ["zz"], ["zz", "yy"]])
            at = rnd.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((d, rnd.choice([" ", "\n", " \t"]).join(w).upper() if d % 3 else " ".join(w)))
    docs += [(90, None), (91, ""), (92, items[0][1]), (None, items[4][1]), (93, items[5][1]), (93, items[5][1]), (94, "la " * 3000), (95, items[0][1] + "  "), (96, " ".join(items[9][1].split()[:-1]))]
    return docs, items


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_equals_brute_force(spark, limit):
    docs, items = tables()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = {tuple(r) for r in D.contaminated(d, i, max_broadcast=limit).collect()}
    want = brute(docs, items)
    assert len(want) > 15
    assert {r[:4] + r[5:] for r in got} == {r[:4] + r[5:] for r in want}
    # of windows that are equally similar, one that begins with a shared shingle is reported
    first = {r[:3]: r[4] for r in want}
    assert all(first[r[:3]] <= r[4] <= first[r[:3]] + 12 for r in got)


def test_empty_tables(spark):
    docs, items = tables()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated(d.limit(0), i).count() == 0
    assert D.contaminated(d, i.limit(0)).count() == 0


def test_rows_are_dropped_by_their_text(spark):
    """Ids that are null or repeat neither save a row nor cost one; null and empty texts stay."""
    item = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "a clean text of some words here", "x"), (1, "before " + item + " after", "y"), (None, item, "z"), (None, "also clean and without id", None), (2, None, "n"), (2, "", "e"), (3, item, "p"), (3, item, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tkey string")
    kept = D.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], *rows[3:6]], key=str)


def test_long_items(spark):
    """An item of 1,000 words with repeats, in a longer text with every 60th word changed."""
    rnd = random.Random(4)
    item = [f"w{rnd.randrange(300)}" for _ in range(1000)] + ["la"] * 12
    leak = [w if i % 60 else "zz" for i, w in enumerate(item)]
    far = [w if i % 9 else "zz" for i, w in enumerate(item)]
    pad = [f"p{i}" for i in range(500)]
    docs = [(1, " ".join(pad + leak + pad)), (2, " ".join(pad + far)), (3, " ".join(pad))]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    want = {r[:4] for r in brute([docs[0][:1] + (" ".join(leak),)], [(7, " ".join(item))])}
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and {r[3] for r in want} == {got[0].similarity} and got[0].start_word in (500, 501)


def test_blocks_find_the_items(spark):
    """Items come from the index of blocks: within the radius all that share an anchor, beyond it none."""
    item_fps = spark.createDataFrame([(1, 0), (2, (1 << 24) - 1)], "cid long, fp long")
    anchored = spark.createDataFrame([(5, 1, 9), (5, 2, 9), (6, 2, 8)], "h long, cid long, length int")
    taken = spark.createDataFrame([("a", 0, 9, 5), ("a", 0, 8, 6)], "tkey string, start int, length int, h long")
    fps = spark.createDataFrame([("a", 0, 9, 3), ("a", 0, 8, (1 << 23) - 1)], "tkey string, start int, length int, fp long")
    got = {tuple(r) for r in D.block_candidates(taken, fps, anchored, item_fps).collect()}
    assert got == {("a", 0, 9, 1), ("a", 0, 9, 2), ("a", 0, 8, 2)}
    off = spark.createDataFrame([("a", 0, 9, -1), ("a", 0, 8, -1)], fps.schema)
    assert D.block_candidates(taken, off, anchored, item_fps).count() == 0


def test_many_hits_in_a_long_text(spark):
    """Twenty thousand words that repeat parts of an item a thousand times, and leak it changed, beside a long item."""
    rnd = random.Random(9)
    item, long_item = [f"i{k}" for k in range(12)], [f"j{k}" for k in range(150)]
    words = []
    while len(words) < 20_000:  # a thousand times
        a = rnd.randrange(7)
        words += item[a : a + 5] + [f"n{rnd.randrange(5000)}" for _ in range(15)]
    words[7001:7013] = item
    words[9000:9150] = long_item[:80] + ["other"] + long_item[81:]  # not at an end, where two windows would be as similar
    docs = [(1, " ".join(words)), (2, " ".join(words[:7000])), (3, " ".join(long_item[:140]))]
    items = [("a", " ".join(item)), ("b", " ".join(long_item))]
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {tuple(r) for r in D.contaminated(d, i).collect()}
    assert got == brute(docs, items) and {(r[0], r[1]) for r in got} == {(1, "a"), (1, "b"), (3, "b")}


def test_similarity_has_a_floor(spark):
    d, i = spark.createDataFrame([], "doc_id int, text string"), spark.createDataFrame([], "item_id string, text string")
    with pytest.raises(ValueError):
        D.contaminated(d, i, similarity=0.5)
