"""License scans against regular expressions, plain Python and SQL."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from tidewell.llm import licenses as lic

SCHEMA = "doc_id long, text string, labels int"


def plain(template, rnd):
    """A text that the template accepts: optional regions in or out, replaceable ones filled."""
    out = []
    for region in template:
        if isinstance(region, bytes):
            out.append(region.decode())
        elif region[0] == "optional":
            out += plain(region[1], rnd) if rnd.random() < 0.5 else []
        elif region[0] == "either":
            out += [w.decode() for w in rnd.choice(region[1])]
        else:
            out += [rnd.choice(["foo", "2020", "é", "license"]) for _ in range(rnd.choice([region[1], region[2]]))]
    return out


def texts(seed, n):
    rnd = random.Random(seed)
    pool = ["mit", "license", "apache", "general", "public", "licensed", "under", "the", "permission", "this", "copyright", "x", "Ünder"]
    rows = []
    for _ in range(n):
        words = [rnd.choice(pool) for _ in range(rnd.randrange(30))]
        template = plain(lic.parse(rnd.choice(lic.TEMPLATES).wording), rnd)
        if rnd.random() < 0.3 and template:  # one mandatory or other word changed
            template[rnd.randrange(len(template))] = "other"
        at = rnd.randrange(len(words) + 1)
        words[at:at] = template
        rows.append("".join(w.upper() + rnd.choice([" ", "\n", ", ", "; -- "]) if rnd.random() < 0.2 else w + " " for w in words))
    return rows


def test_automaton_equals_expressions():
    patterns = [(t.label, re.compile(" " + lic._pattern(lic.parse(t.wording)))) for t in lic.PHRASES + lic.TEMPLATES]
    automaton = lic.Automaton(lic.PHRASES + lic.TEMPLATES)
    hits = 0
    for text in texts(1, 400):
        words = lic.words_of(text)
        joined = " " + b" ".join(words).decode() + " "
        got = {t for t, _, _ in automaton.places(words)}
        assert got == {i for i, (_, p) in enumerate(patterns) if p.search(joined)}, text
        hits += bool(got)
    assert hits > 250


def test_places_are_the_longest():
    t = (lic.Template("a", "one <<beginOptional>>two<<endOptional>> <<var;name=\"n\";original=\"x\";words=\"0,2\">> end <<beginOptional>>now<<endOptional>>"), lic.Template("b", "end now", True))
    automaton = lic.Automaton(t)
    words = b"one end one two z end now one one two a b c end one x end".split()
    assert automaton.places(words) == [(0, 0, 2), (0, 2, 5), (1, 5, 2), (0, 14, 3)]
    automaton.MOST_STEPS = 3
    automaton.made.clear()
    assert automaton.places(words) == [(0, 0, 2), (0, 2, 5), (1, 5, 2), (0, 14, 3)]


@pytest.mark.parametrize("wording", ["a <<beginOptional>> b", "a <<endOptional>>", "<<what>> a", "<<var;name=\"x\";original=\"y\";words=\"0,3\">> a", "<<beginOptional>>a<<endOptional>>"])
def test_bad_templates(wording):
    with pytest.raises(ValueError):
        lic.Automaton((lic.Template("x", wording),))


def test_query_and_sql(spark, tmp_path):
    rows = [(i, t, 1) for i, t in enumerate(texts(2, 150))]
    rows += [(900, None, 1), (901, "", 1), (902, "MIT license, Apache-License general public; license mit.license", 1), (None, "mit license", 1), (902, "x " * 30_000 + "mit license", 1), (903, "the permit license and mitlicense", 1), (904, "licensed under " * 20_000, 1)]
    rows += rows[:5]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = lic.op12_license_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine = sorted(map(tuple, got.collect()), key=str)
    assert mine == sorted(con.sql(lic.ORACLE_SQL).select(", ".join(got.columns)).fetchall(), key=str)
    by = {r.doc_id: r for r in got.filter("doc_id in (900, 902, 903)").collect() if r.n_words < 1000}
    assert (by[902].n_words, by[902].n_base, by[902].first_word, by[902].last_word, by[902].base_labels) == (9, 4, 0, 7, "apache,gpl,mit")
    assert by[900].first_word is None and by[900].labels == "" and by[903].n_base == 0
    lines = {"Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc", "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0"}
    notices = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    found = {r.doc_id: ",".join(sorted({p.label for p in r.places})) for r in lic.scan(notices).collect()}
    assert [found[i] for i in range(4)] == list(lines.values())
    assert lic.scan(notices.limit(0)).count() == 0
