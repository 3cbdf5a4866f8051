from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
import struct
import zipfile

import pytest

from tidewell.llm import pii, toxicity, warc
from tidewell.storage import new_path

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    found = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = [int(c) for c in reversed(digits)]
            good = (sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10 == 0
            ok = [True, all(int(x) <= 255 for x in m.group().split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and good, 10 <= len(digits) <= 15][kind]
            if ok:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(4)
    pieces = ["a@b.c", "@x.y@z.w", "a.b@c", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "001.2.3.4", "4111111111111111", "4111 1111-1111 1111", "+1 (269) 555-3296", "+1234567890 12", "+", "@", ".", " ", "é", "12", "a", "-", "(", "\n"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12)))
        assert pii.base_spans(text) == brute(text), text
    for long in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1 " * 100_000, "1." * 100_000):
        pii.base_spans(long)


def test_contexts_find_unseen(spark):
    rows = [(i, f"please write to user{i}@mail.example.com today or use key AKIA{i:04d}Q7ZK{i:04d}B now") for i in range(12)]
    rows += [(100 + i, f"write to AKIA{i:04d}QQRR{i:04d}X today") for i in range(8)]
    rows += [(200, None), (201, ""), (202, "version 2.0 of release-2024-build99 is out"), (None, "nobody@mail.example.com"), (203, "x" * 50_000)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, row int")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(got) == len(rows)
    assert all(len(got[100 + i].added) == 1 for i in range(8))
    assert not got[202].added and not got[202].base and not got[200].base and len(got[None].base) == 1
    assert pii.find(docs.limit(0)).count() == 0
    assert pii.redact(docs).filter("doc_id = 0").first().text.startswith("please write to [removed] today")


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")


def test_archives_round_trip(spark):
    big = "<p>é</p>" * 50
    rows = [(1, "http://a/b c?d=\n", big), (2, "http://a/2", big), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "y" * 100), (8, "u", "y" * 100), (1, "http://again", big), (9, "u", "z" * 99), (10, "u", "z" * 99), (11, "u", "\r\n\r\nhead" * 40_000)]
    manifest = warc.write_packages(pages(spark, rows), new_path(spark, "archives"), package_bytes=20_000)
    got = warc.read_packages(manifest, read_bytes=10_000).collect()
    assert len(got) == len(rows)
    want = []
    for page, url, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if h == html and p is not None), default=None)
        refers = first if len(data) >= 100 and page != first else None
        want.append((page, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers, None if refers is not None else data))
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got), key=str) == sorted(want, key=str)
    assert warc.read_packages(warc.write_packages(pages(spark, []), new_path(spark, "archives"))).count() == 0


def test_directories():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(66_000):  # more entries than the plain record can count
            z.writestr(f"e{i}", b"")
        z.writestr("indexes/é.cdxj", b"packed " * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    members = warc.directory(data, len(data.getvalue()))
    assert len(members) == 66_001 and members[-1].name == "indexes/é.cdxj"
    assert warc.member_bytes(data, members[-1]) == b"packed " * 100
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"no archive at all, only some bytes"), 34)
    wide = struct.pack("<HHQQQ", 1, 24, 5, 6, 7)
    entry = b"PK\x01\x02" + struct.pack("<6H3L5H2L", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + b"n" + wide
    zip64 = b"PK\x06\x06" + struct.pack("<Q2H2L4Q", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    locator = b"PK\x06\x07" + struct.pack("<LQL", 0, len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<4H2LH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = entry + zip64 + locator + end
    assert warc.directory(io.BytesIO(whole), len(whole)) == [warc.Member("n", 0, 6, 5, 7)]
    packed = gzip.compress(warc.record(3, "u", "response", b"abc", 3, hashlib.sha256(b"abc").hexdigest(), None))
    assert warc.parse_record(packed)["payload"] == b"abc"


def test_toxicity(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rnd.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            text.insert(rnd.randrange(40), rnd.choice(["nasty", "vileone", "vilethat"]))
        poor = i % 7 == 0
        rows.append((i, " ".join(text) + (" %%% spam" if poor else "")))
        if i < 450:
            labels.append((i, int(not poor), int(toxic)))
    rows += [(900, None), (901, ""), (None, "nasty"), (902, "w1 " * 20_000 + "nasty"), (3, rows[3][1])]
    labels += [(5, None, 1), (None, 1, 1), (7777, 1, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = toxicity.score(docs, marks, max_per_class=400)
    assert got.columns == ["doc_id", "p_quality", "p_toxic", "toxic"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 600:
            assert r.toxic == (r.doc_id % 5 == 0), r
    assert {r.doc_id: r.toxic for r in got}[902] and not {r.doc_id: r.toxic for r in got}[900]
    assert toxicity.score(docs, marks.limit(0)).agg({"p_toxic": "max"}).first()[0] < 1e-6
    assert toxicity.score(docs.limit(0), marks).count() == 0
