"""License scans by template-markup matching.

A template is license wording with markup: ``<<opt>> ... <</opt>>`` encloses
words that may be absent, ``<<var;1..4>>`` stands for a replaceable run of so
many words, ``<<var;1..4;pattern>>`` of such words. It is compiled into an
automaton over words; a text matches at a place when its words lead from the
start to the end and every mandatory word agrees exactly. Short licenses
(MIT, ISC, BSD) are whole, from the grant to the end of the disclaimer; of
long ones the standard notices are given, and ``text_templates`` makes
templates of the whole texts that a caller has. Runs of the automaton start only where its first mandatory
words stand, which a search in the joined words finds.

Plain phrases are looked up beside the templates (places where their words
stand consecutively); they give the base labels.

Words are lower-cased runs of digits, letters and non-ASCII characters, so
punctuation, case and line breaks never matter.

Defined cases: null texts count as empty; texts without words have no match
and score 0. Of the ends that an automaton reaches from one place the longest
counts, and places of one template may overlap. A label found twice counts once.
"""

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcast.llm import words

# The phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_ITEM = "<<var;0..1;[0-9a-c]>>"
_PARTY = "<<var;1..12>>"
_BSD_START = f"""
redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met
{_ITEM} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
{_ITEM} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
disclaimer in the documentation and or other materials provided with the distribution
"""
_BSD_END = f"""
this software is provided by {_PARTY} as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {_PARTY} be liable for any
direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute
goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
advised of the possibility of such damage
"""


def _gnu_notice(name: str, version: str) -> str:
    """The usual notice of a GNU license, with the choice of a later version."""
    return f"""
you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation
<<opt>>either<</opt>> version {version} of the license <<opt>>or at your option any later version<</opt>>
"""


_GPL, _LGPL = "gnu general public license", "gnu lesser general public license"

# Wording of notices and of short licenses as templates; labels follow common short names. A label may
# have several. Whole texts end in "-text" where notices have a label of their own.
TEMPLATES = {
    "mit-notice": "<<opt>>this <<var;1..3>> is<</opt>> released under the <<opt>>terms of the<</opt>> mit license",
    "mit-text": f"""
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
<<opt>>the software<</opt>> to deal in the software without restriction including without limitation the rights to use copy modify
merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to
do so subject to the following conditions
the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or
substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and <<var;1..2;noninfringement|non|infringement>> in no event shall {_PARTY} be
liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
connection with the software or the use or other dealings in the software
""",
    "isc": f"""
permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies
the software is provided as is and {_PARTY} disclaims all warranties with regard to this software including all implied warranties
of merchantability and fitness in no event shall {_PARTY} be liable for any special direct indirect or consequential damages or any
damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
arising out of or in connection with the use or performance of this software
""",
    "bsd-2-clause": _BSD_START + _BSD_END,
    "bsd-3-clause": f"""{_BSD_START}
{_ITEM} neither the name of {_PARTY} nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission {_BSD_END}""",
    "apache-2.0": "licensed under the apache license <<opt>>version<</opt>> 2 0 <<opt>>the license<</opt>>",
    "apache-2.0-notice": """
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
obtain a copy of the license at <<opt>>http<</opt>> <<opt>>https<</opt>> www apache org licenses license 2 0 <<opt>>txt<</opt>>
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
without warranties or conditions of any kind either express or implied see the license for the specific language governing
permissions and limitations under the license
""",
    "gpl-3.0": [
        "licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> <<opt>>version<</opt>> 3 <<opt>>or any later version<</opt>>",
        _gnu_notice(_GPL, "3"),
    ],
    "gpl-2.0": [
        "licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> <<opt>>version<</opt>> 2 <<opt>>or any later version<</opt>>",
        _gnu_notice(_GPL, "2"),
    ],
    "lgpl": [
        "licensed under the <<opt>>terms of the<</opt>> gnu lesser general public license <<opt>>version <<var;1..2;[0-9]+>><</opt>>",
        _gnu_notice(_LGPL, "<<var;1..2;[0-9]>>"),
    ],
    "cc-by": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by <<var;1..2;[0-9]+>>",
    "cc-by-sa": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by sa <<var;1..2;[0-9]+>>",
    "cc-by-nc": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by nc <<var;1..2;[0-9]+>>",
    "cc-by-nc-sa": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by nc sa <<var;1..2;[0-9]+>>",
    "cc-by-nd": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by nd <<var;1..2;[0-9]+>>",
    "creative-commons": "licensed under a creative commons <<var;1..6>> license",
    "mpl-2.0": "subject to the terms of the mozilla public license <<opt>>v<</opt>> <<opt>>version<</opt>> 2 0",
    "mpl-2.0-notice": """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
file you can obtain one at <<opt>>http<</opt>> <<opt>>https<</opt>> mozilla org mpl 2 0
""",
    "all-rights-reserved": "copyright <<opt>>c<</opt>> <<var;1..8>> all rights reserved",
}
# What a word list is scored: a full template, else a phrase alone.
FULL, PART = 1.0, 0.5
MARK = re.compile(r"<<opt>>|<</opt>>|<<var;(\d+)\.\.(\d+)(?:;([^>]+))?>>|[^\s<]+")
ANY = None


def _fits(on: bytes | re.Pattern | None, word: bytes) -> bool:
    return on is ANY or on == word or isinstance(on, re.Pattern) and on.fullmatch(word) is not None


@dataclass
class Automaton:
    """States 0..end; each has steps (word, pattern or ANY; next state) and free steps."""

    label: str
    steps: list[list[tuple[bytes | re.Pattern | None, int]]]
    free: list[list[int]]
    end: int
    anchor: bytes
    lead: int

    def _reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for state in self.free[todo.pop()]:
                if state not in seen:
                    seen.add(state)
                    todo.append(state)
        return seen

    def run(self, found: list[bytes], at: int) -> int | None:
        """The end (exclusive) of the longest match that starts at a word."""
        states, last, place = self._reach({0}), None, at
        while states:
            if self.end in states:
                last = place
            if place >= len(found):
                break
            word = found[place]
            states = self._reach({to for s in states for on, to in self.steps[s] if _fits(on, word)})
            place += 1
        return last


def compile_template(label: str, markup: str) -> Automaton:
    """Markup to an automaton; its longest mandatory run of words is the anchor."""
    steps: list[list] = [[]]
    free: list[list[int]] = [[]]
    open_at, runs, run, depth = [], [], [], 0
    # Each word adds a state: a state's number bounds the words before it.
    begun = 0

    def add() -> int:
        steps.append([])
        free.append([])
        return len(steps) - 1

    now = 0
    for mark in MARK.finditer(markup):
        text = mark.group()
        if text == "<<opt>>":
            open_at.append(now)
            depth += 1
        elif text == "<</opt>>":
            free[open_at.pop()].append(now)
            depth -= 1
        elif mark.group(1):
            least, most = int(mark.group(1)), int(mark.group(2))
            on = re.compile(mark.group(3).encode()) if mark.group(3) else ANY
            skips = []
            for n in range(most):
                if n >= least:
                    skips.append(now)
                to = add()
                steps[now].append((on, to))
                now = to
            for s in skips:
                free[s].append(now)
        else:
            for word in words.folded_words(text.encode()):
                to = add()
                steps[now].append((word, to))
                now = to
                if not depth:
                    begun = begun if run else now - 1
                    run.append(word)
            continue
        if run:
            runs.append((run, begun))
            run = []
    if run:
        runs.append((run, begun))
    if open_at or not runs:
        raise ValueError(f"template {label} is open-ended or has no mandatory word")
    # A free end of an optional region leads to the state after it.
    longest, lead = max(runs, key=lambda x: len(x[0]))
    return Automaton(label, steps, free, now, b" ".join(longest), lead)


@lru_cache(maxsize=8)
def _compiled(templates: tuple[tuple[str, str], ...]) -> list[Automaton]:
    return [compile_template(label, markup) for label, markup in templates]


def markups(templates: dict[str, str | list[str]]) -> tuple[tuple[str, str], ...]:
    """(label, markup) of every template, several for a label that has a list."""
    return tuple((label, m) for label, some in templates.items() for m in ([some] if isinstance(some, str) else some))


def text_templates(texts: dict[str, str]) -> dict[str, str]:
    """Templates from whole license texts: every word is mandatory, whatever marks the text holds."""
    return {label: b" ".join(words.folded_words(text.encode())).decode() for label, text in texts.items()}


class Scanner:
    """Phrases and automata over the words of one text."""

    def __init__(self, templates: dict[str, str | list[str]] | None = None, phrases: dict[str, str] | None = None):
        self.automata = _compiled(markups(TEMPLATES if templates is None else templates))
        self.phrases = [(words.folded_words(p.encode()), label) for p, label in (PHRASES if phrases is None else phrases).items()]

    def places(self, joined: bytes, phrase: bytes) -> list[int]:
        """Word numbers at which a phrase starts; ``joined`` has a space around every word."""
        found, at, word, last = [], 0, 0, 0
        needle = b" " + phrase + b" "
        while (at := joined.find(needle, at)) >= 0:
            word += joined.count(b" ", last, at)
            last = at
            found.append(word)
            at += 1
        return found

    def scan(self, raw: bytes | None) -> dict:
        found = words.folded_words(raw or b"")
        joined = b" " + b" ".join(found) + b" "
        matches = []
        for phrase, label in self.phrases:
            matches += [(label, "phrase", s, s + len(phrase)) for s in self.places(joined, b" ".join(phrase))]
        for automaton in self.automata:
            tried = set()
            for s in self.places(joined, automaton.anchor):
                tried.update(range(max(0, s - automaton.lead), s + 1))
            ends: dict[int, int] = {}
            seen = set()
            for s in sorted(tried):
                e = automaton.run(found, s)
                # Starting before an optional region gives the longer match of the same end.
                if e is not None and e not in seen:
                    ends[s] = e
                    seen.add(e)
            matches += [(automaton.label, "template", s, e) for s, e in ends.items()]
        matches = set(matches)
        keys = ("label", "kind", "start_word", "end_word")
        return {"n_words": len(found), "matches": [dict(zip(keys, m)) for m in sorted(matches, key=lambda m: (m[2], m[3], m[0]))]}


_TYPE = "struct<n_words:long,matches:array<struct<label:string,kind:string,start_word:long,end_word:long>>>"
_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("matches", pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64())]))),
])


def scan_column(text: Column, templates: dict[str, str | list[str]] | None = None, phrases: dict[str, str] | None = None) -> Column:
    """Struct of a text's number of words and its matches (label, kind, start_word, end_word)."""

    @F.arrow_udf(_TYPE)
    def scanned(column: pa.Array) -> pa.Array:
        scanner = Scanner(templates, phrases)
        return pa.array([scanner.scan(raw) for raw in words.raw_texts(column)], _ARROW)

    return scanned(text)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per document: id, n_words, matches."""
    return docs.select(docs[id_col], scan_column(docs[text_col], **settings).alias("found")).select(id_col, "found.*")


def license_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers and labels of a scan: the base phrases' places, and all labels."""
    base = F.filter("matches", lambda m: m["kind"] == "phrase")
    full = F.exists("matches", lambda m: m["kind"] == "template")
    starts = F.transform(F.col("base"), lambda m: m["start_word"])

    def joined(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return scanned.withColumn("base", base).select(
        id_col, "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.when(full, FULL).when(F.size("base") > 0, PART).otherwise(0.0).alias("score"),
    )
