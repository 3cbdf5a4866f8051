"""License scans: templates with markup, compiled into token automata.

A template is a license's wording with two kinds of marked regions:

- ``<<beginOptional>> ... <<endOptional>>`` may be left out, and may hold other regions;
- ``<<var;name="...";original="...";words="0,20">>`` is replaced by so many words of any
  kind, ``<<var;name="...";original="...";match="version 3|v3">>`` by one of the wordings.

All else is mandatory and has to stand word for word. Words are runs of digits, letters
and characters beyond ASCII, with A-Z folded, so punctuation, case and line breaks do not
count. All templates form one automaton over words: a state is a set of places in
templates, its steps are made when a text first takes them. It is started at every word
that can begin a template and runs until no place is left; the longest accepted stretch of
each template counts. A start reads no more words than the longest template has, so a text
is read in one pass of bounded cost a word, in the task where its row lies.

A phrase is a template without regions; the phrases of PHRASES are the base.

Defined cases: a null text is empty and has no words; repeated rows count each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    label: str
    wording: str
    phrase: bool = False


#: The base phrases and their labels.
PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))

_GRANTED = '<<var;name="verb";original="licensed";match="licensed|released|distributed|published|available|made available|provided">> under'
_HOLDER = '<<beginOptional>>Copyright <<var;name="holder";original="(c) year holder";words="0,20">> <<beginOptional>>All rights reserved.<<endOptional>><<endOptional>>'
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY <<var;name="by";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";words="1,20">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_SOURCE_AND_BINARY = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

#: The wording of licenses and of the notices that apply them.
TEMPLATES = (
    Template("mit", f"{_GRANTED} the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    Template(
        "mit",
        f"""<<beginOptional>>The MIT License<<beginOptional>>(MIT)<<endOptional>><<endOptional>> {_HOLDER}
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall
be included in all copies or substantial portions of the Software. <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
<<endOptional>>""",
    ),
    Template("apache-2.0", f"{_GRANTED} the <<beginOptional>>terms of the<<endOptional>> Apache License <<var;name=\"version\";original=\"Version 2.0\";match=\"version 2.0|v 2.0|v2.0|2.0\">>"),
    Template(
        "apache-2.0",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<var;name="address";original="http://www.apache.org/licenses/LICENSE-2.0";match="http www apache org licenses license 2.0|https www apache org licenses license 2.0">>
<<beginOptional>>Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.<<endOptional>>""",
    ),
    Template("gpl-3.0", f"{_GRANTED} the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License <<beginOptional>>(GPL)<<endOptional>> <<var;name=\"version\";original=\"version 3\";match=\"version 3|v 3|v3|version 3.0\">>"),
    Template("gpl-2.0", f"{_GRANTED} the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License <<beginOptional>>(GPL)<<endOptional>> <<var;name=\"version\";original=\"version 2\";match=\"version 2|v 2|v2|version 2.0\">>"),
    Template(
        "gpl-or-later",
        """is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU
<<beginOptional>><<var;name="kind";original="Lesser";match="lesser|affero|library">><<endOptional>> General Public License as published by the
Free Software Foundation<<beginOptional>>,<<endOptional>> either version <<var;name="version";original="3";match="1|2|2.1|3">> of the License, or
(at your option) any later version.""",
    ),
    Template("bsd-2-clause", f"{_HOLDER} {_SOURCE_AND_BINARY} {_AS_IS}"),
    Template(
        "bsd-3-clause",
        f"""{_HOLDER} {_SOURCE_AND_BINARY} <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="owner";original="the copyright
holder";words="1,20">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission.""",
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, <<var;name="and";original="and/or";match="and or|and">> distribute this software for any purpose with
or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
    Template(
        "cc",
        f"""{_GRANTED} <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
<<var;name="name";original="CC";match="cc|creative commons|creative commons attribution">> <<var;name="terms";original="BY";match="by|by sa|by nc|by nd|by nc sa|by nc nd|noncommercial|sharealike|noncommercial sharealike|zero|0|4.0 international|international license">>""",
    ),
)

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MARK = re.compile(r"<<(.*?)>>", re.DOTALL)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def parse(wording: str) -> list:
    """The regions of a template: a word (bytes), ("optional", regions), ("any", least, most), ("either", [regions, ...])."""
    levels: list[list] = [[]]
    at = 0
    for mark in MARK.finditer(wording):
        levels[-1] += words_of(wording[at : mark.start()])
        at = mark.end()
        kind, *rest = mark.group(1).split(";")
        if kind == "beginOptional":
            levels.append([])
        elif kind == "endOptional" and len(levels) > 1:
            inner = levels.pop()
            if inner:  # one that holds punctuation only changes nothing
                levels[-1].append(("optional", inner))
        elif kind == "var":
            values = dict(re.findall(r'(\w+)="(.*?)"', ";".join(rest), re.DOTALL))
            if "words" in values:
                least, most = map(int, values["words"].split(","))
                levels[-1].append(("any", least, most))
            else:
                levels[-1].append(("either", [words_of(x) for x in values["match"].split("|")]))
        else:
            raise ValueError(f"unknown or unmatched mark <<{mark.group(1)}>>")
    if len(levels) > 1:
        raise ValueError("an optional region is not closed")
    return levels[0] + words_of(wording[at:])


class Automaton:
    """All templates over words; ``places`` finds every start at which one is accepted."""

    #: Steps that are remembered; all are forgotten when there are more, as they can be made again.
    MOST_STEPS = 200_000

    def __init__(self, templates: tuple[Template, ...]):
        self.steps: list[list[tuple[bytes | None, int]]] = []  # None: any word
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        starts = []
        for number, template in enumerate(templates):
            starts.append(self._state())
            self.accepts[self._chain(parse(template.wording), starts[-1])] = number
        self.known = {w for outs in self.steps for w, _ in outs if w is not None}
        self.states: list[frozenset[int]] = []
        self.ids: dict[frozenset[int], int] = {}
        self.accepted: list[list[int]] = []
        self.made: dict[tuple[int, bytes], int] = {}
        self.start = self._number(starts)
        begins = [w for s in self.states[self.start] for w, _ in self.steps[s]]
        if None in begins or self.accepted[self.start]:
            raise ValueError("a template begins with a region of any words, or accepts no words at all")
        self.first = frozenset(begins)

    def _state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _chain(self, regions: list, at: int) -> int:
        for region in regions:
            after = self._state()
            if isinstance(region, bytes):
                self.steps[at].append((region, after))
            elif region[0] == "optional":
                self.free[self._chain(region[1], at)].append(after)
                self.free[at].append(after)
            elif region[0] == "either":
                for way in region[1]:
                    self.free[self._chain(way, at)].append(after)
            else:
                for i in range(region[2]):
                    if i >= region[1]:
                        self.free[at].append(after)
                    inner = self._state()
                    self.steps[at].append((None, inner))
                    at = inner
                self.free[at].append(after)
            at = after
        return at

    def _number(self, places) -> int:
        found, waiting = set(places), list(places)
        while waiting:
            for s in self.free[waiting.pop()]:
                if s not in found:
                    found.add(s)
                    waiting.append(s)
        state = frozenset(found)
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.accepted.append(sorted({self.accepts[s] for s in state if s in self.accepts}))
        return self.ids[state]

    def _step(self, state: int, word: bytes) -> int:
        """The state after a word; -1 if no place is left."""
        after = [n for s in self.states[state] for w, n in self.steps[s] if w is None or w == word]
        if len(self.made) >= self.MOST_STEPS:
            self.made.clear()
        self.made[state, word] = made = self._number(after) if after else -1
        return made

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, number of words), the longest of each template at each start."""
        found, made, known = [], self.made, self.known
        for i in [i for i, w in enumerate(words) if w in self.first]:
            state, longest, at = self.start, {}, i
            while state >= 0 and at < len(words):
                word = words[at] if words[at] in known else b""
                at += 1
                after = made.get((state, word))
                state = self._step(state, word) if after is None else after
                if state >= 0:
                    for t in self.accepted[state]:
                        longest[t] = at - i
            found += [(t, i, n) for t, n in sorted(longest.items())]
        return found


@cache
def _automaton(templates: tuple[Template, ...]) -> Automaton:
    return Automaton(templates)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = PHRASES + TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places) per row; a place has the template's label, whether it is a phrase, its first word and number of words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    place = pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(templates)
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                counts.append(len(words))
                found.append([{"label": templates[t].label, "phrase": templates[t].phrase, "first": i, "words": n} for t, i, n in automaton.places(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(place))], ["doc_id", "n_words", "places"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, places array<struct<label:string,phrase:boolean,first:bigint,words:bigint>>")


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    """score: 1 if a template's whole mandatory wording stands in the text, 0.5 if a base phrase only, else 0."""
    base = F.filter("places", lambda p: p["phrase"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["first"])
    whole = F.exists("places", lambda p: ~p["phrase"])
    score = F.when(whole, 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0)
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"), score.alias("score"))


def _pattern(regions: list) -> str:
    """A regular expression of the template over words that are each followed by a space."""
    found = ""
    for region in regions:
        if isinstance(region, bytes):
            found += region.decode() + " "
        elif region[0] == "optional":
            found += f"(?:{_pattern(region[1])})?"
        elif region[0] == "either":
            found += f"(?:{'|'.join(map(_pattern, region[1]))})"
        else:
            found += f"(?:[^ ]+ ){{{region[1]},{region[2]}}}"
    return found


def _oracle() -> str:
    """DuckDB SQL with the same rows: phrases by places of words, templates as regular expressions over the joined words."""
    phrases = [(t.label, parse(t.wording)) for t in PHRASES]
    at = [" AND ".join(f"w[i + {k}] = '{x.decode()}'" for k, x in enumerate(words, 1)) for _, words in phrases]
    places = " || ".join(f"list_filter(range(len(w)), lambda i: {x})" for x in at)
    base = ", ".join(f"CASE WHEN len(list_filter(range(len(w)), lambda i: {x})) > 0 THEN '{label}' END" for x, (label, _) in zip(at, phrases, strict=True))
    whole = ", ".join(f"CASE WHEN regexp_matches(joined, ' {_pattern(parse(t.wording))}') THEN '{t.label}' END" for t in TEMPLATES)
    names = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, {places} AS places, [{base}] AS base FROM cut),
named AS (SELECT *, [{whole}] AS whole FROM found)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, {names.format("base")} AS base_labels, {names.format("base || whole")} AS labels,
  CASE WHEN len(list_filter(whole, lambda x: x IS NOT NULL)) > 0 THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM named"""


ORACLE_SQL = _oracle()
