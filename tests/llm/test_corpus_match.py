"""Decontamination and license scans against brute force."""

import itertools
import random
import re

import pytest

from tabcast.llm import decontaminate, license_scan
from corpus_rows import prose


def folded(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def slow_matches(text, item):
    """The best (n_agree, -start) of any diagonal on which the item agrees enough."""
    words, own = folded(text), folded(item)
    best = None
    if len(own) < decontaminate.MIN_ITEM:
        return None
    for shift in range(-len(own) + 1, len(words)):
        places = [j for j in range(len(own)) if 0 <= shift + j < len(words)]
        same = [words[shift + j] == own[j] for j in places]
        if len(own) < decontaminate.MIN_WORDS:
            if len(places) == len(own) and sum(same) >= decontaminate.SHARE * len(own):
                best = max(best or (0, 0), (sum(same), -shift))
            continue
        for a in range(len(same)):
            for b in range(a + decontaminate.MIN_WORDS, len(same) + 1):
                agree = sum(same[a:b])
                if agree >= decontaminate.MIN_WORDS and agree >= decontaminate.SHARE * (b - a):
                    best = max(best or (0, 0), (agree, 0))
    return best


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(2)
    items = [prose(rng, n, "uvwxyzé") for n in (40, 30, 25, 20, 14, 9, 6, 4, 13)]
    rows = list(enumerate(items)) + [(50, None), (51, ""), (None, prose(rng, 20, "uvwxyz")), (3, items[3])]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


def leaked(rows):
    rng = random.Random(4)
    out = []
    for i, (_, text) in enumerate(rows):
        if not text:
            continue
        own = text.split()
        changed = list(own)
        for j in range(4, len(own), 7):  # one word in seven is another
            changed[j] = "other"
        for n, body in enumerate((own, changed, own[: len(own) // 2], [w.upper() + "," for w in own])):
            out.append((100 * i + n, f"{prose(rng, 30, 'abcdef')} {' '.join(body)} {prose(rng, 20, 'abcdef')}"))
    return [*out, (9000, None), (9001, ""), (9002, prose(rng, 500, "abcdef")), (None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1])]


def test_overlaps(spark, bench):
    frame, items = bench
    texts = leaked(items)
    docs = spark.createDataFrame([(*t, "own", 1) for t in texts], "doc_id long, text string, item string, _doc int")
    found = decontaminate.contamination(docs, frame).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    want = {(d, i) for d, t in texts for i, x in items if slow_matches(t, x)}
    # Spaced seeds find every overlap planted here; what they find is an overlap.
    assert got == want
    for r in found:
        assert r["n_agree"] >= decontaminate.SHARE * r["n_words"]
    kept = decontaminate.decontaminated(docs, frame)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(str(d) for d, t in texts if not any(slow_matches(t, x) for _, x in items))


def test_masks_miss_no_long_overlap():
    """Of all patterns that no mask fits, those with the fewest other words have too many to count."""
    width = max(map(len, decontaminate.MASKS))
    fits = [sum(1 << (len(m) - 1 - i) for i, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS]
    free = [not any(s & f == f for f in fits) for s in range(1 << width)]
    least = {0: 0}  # last words that agree, as bits: fewest other words so far
    for n in range(1, 101):
        after = {}
        for state, other in least.items():
            for agrees in (0, 1):
                to = (state << 1 | agrees) & ((1 << width) - 1)
                if free[to]:
                    after[to] = min(after.get(to, n), other + 1 - agrees)
        least = after
        if n >= decontaminate.MIN_WORDS:
            other = min(least.values())
            assert n - other < decontaminate.MIN_WORDS or other > (1 - decontaminate.SHARE) * n + 1e-9, n


def test_masks_miss_no_short_item():
    for n in range(decontaminate.MIN_ITEM, decontaminate.MIN_WORDS):
        own = [f"w{i}" for i in range(n)]
        index = decontaminate.Index().build([(1, " ".join(own))])
        for m in range(int((1 - decontaminate.SHARE) * n + 1e-9) + 1):
            for places in itertools.combinations(range(n), m):
                text = " ".join("other" if i in places else w for i, w in enumerate(own))
                assert index.matches([f"x {text} y".encode()])[0], (n, places)


def test_substitutions_at_the_share():
    rng = random.Random(9)
    for n in (15, 20, 50, 100):
        own = [f"w{i}" for i in range(n)]
        index = decontaminate.Index().build([(1, " ".join(own))])
        chosen = [set(range(phase, n, 5)) for phase in range(5)] + [set(rng.sample(range(n), n // 5)) for _ in range(200)]
        for places in chosen:
            text = " ".join("other" if i in places else w for i, w in enumerate(own))
            assert index.matches([text.encode()])[0], (n, places)


def test_blocks_give_the_same(spark, bench):
    frame, items = bench
    docs = spark.createDataFrame(leaked(items), "doc_id long, text string")
    one = sorted(map(str, decontaminate.contamination(docs, frame).collect()))
    assert sorted(map(str, decontaminate.contamination(docs, frame, block=30).collect())) == one
    assert len(list(decontaminate.indexes(frame, block=30))) > 3


def test_hits_across_texts_do_not_count():
    item = " ".join(f"w{i}" for i in range(20))
    index = decontaminate.Index().build([(1, item)])
    half = item.encode().split(b" w10 ")
    assert index.matches([half[0], b"w10 " + half[1]]) == [[], []]
    assert index.matches([item.encode()])[0][0]["n_agree"] == 20


def test_empty_tables(no_docs, docs, bench):
    frame = bench[0]
    assert decontaminate.contamination(no_docs, frame).count() == 0
    assert decontaminate.contamination(docs, frame.limit(0)).count() == 0
    assert decontaminate.decontaminated(docs, frame.limit(0)).count() == docs.count()


def slow_base(text):
    words = folded(text)
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        own = phrase.split()
        for p in range(len(words) - len(own) + 1):
            if words[p : p + len(own)] == own:
                places.append(p)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


NOTICES = {
    "Released under the MIT License.": ("mit", "mit,mit-notice"),
    "released UNDER the terms of the mit license": ("mit", "mit,mit-notice"),
    "Licensed under the Apache License, Version 2.0.": ("apache", "apache,apache-2.0"),
    "This work is licensed under the GNU General Public License, version 3.": ("gpl", "gpl,gpl-3.0"),
    "Licensed under CC BY-NC 4.0.": ("", "cc-by-nc"),
    "Licensed under CC BY 4.0.": ("", "cc-by"),
    "Copyright (c) 2020 Some One. All rights reserved.": ("", "all-rights-reserved"),
    "the mit license mit license": ("mit", "mit"),
    "mit licenses, a permit license, general public": ("", ""),
    "licensed under the apache license version 3": ("apache", "apache"),
    "Copyright 2020 one two three four five six seven eight nine all rights reserved": ("", ""),
}


def test_licenses(spark):
    rng = random.Random(6)
    texts = list(NOTICES) + [f"{prose(rng, 40, 'abc')}\n{t}\n{prose(rng, 30, 'abc')}" for t in NOTICES] + ["", None, " ,.", "é mit\x00license é"]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(texts)], "doc_id long, text string, matches string, base int")
    got = {r["doc_id"]: r for r in license_scan.license_digest(license_scan.license_scan(docs)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == slow_base(text)
        for notice, (base, labels) in NOTICES.items():
            if text and notice in text and (text == notice or "\n" in text):
                assert (r["base_labels"], r["labels"]) == (base, labels), notice
        assert 0 <= r["score"] <= 1


def test_automata_against_regular_expressions():
    markup = "a b <<opt>>c <<var;1..2>><</opt>> d <<opt>>e<</opt>> <<var;0..1>> f"
    flat = re.compile(r"a b (?:c (?:\S+ ){1,2})?d (?:e )?(?:\S+ ){0,1}f ")
    automaton = license_scan.compile_template("x", markup)
    rng = random.Random(1)
    for _ in range(3000):
        words = ["a", "b"] + [rng.choice("abcdef") for _ in range(rng.randint(1, 7))]
        ends = [e for e in range(len(words) + 1) if flat.fullmatch("".join(w + " " for w in words[:e]))]
        assert automaton.run([w.encode() for w in words], 0) == max(ends, default=None)


def test_template_needs_mandatory_words():
    with pytest.raises(ValueError):
        license_scan.compile_template("x", "<<opt>>a<</opt>>")


def worded(template, rng):
    """Words of a template's text, and whether each is mandatory: optional regions at random, replaceable ones filled."""
    out, gone, depth = [], 0, 0
    for mark in license_scan.MARK.finditer(template):
        text, least, most, kind = mark.group(0, 1, 2, 3)
        depth += (text == "<<opt>>") - (text == "<</opt>>")
        if text == "<<opt>>":
            gone = gone + 1 if gone or rng.random() < 0.5 else 0
        elif text == "<</opt>>":
            gone = max(0, gone - 1)
        elif not gone:
            if least:
                some = [w for w in ["1", "noninfringement", "some"] if re.fullmatch(kind or "some", w)]
                out += [(some[0], False)] * max(int(least), rng.randint(0, 1))
            else:
                out.append((text, not depth))
    return out


WHOLE = ("mit-text", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2.0-notice", "mpl-2.0-notice")


@pytest.mark.parametrize("label", WHOLE)
def test_whole_licenses(label):
    """A whole text has its own label and no other whole one; each changed or dropped mandatory word loses it."""
    scanner, rng = license_scan.Scanner(), random.Random(3)

    def labels(words):
        return {m["label"] for m in scanner.scan(" ".join(words).encode())["matches"]} & set(WHOLE)

    for _ in range(5):
        tokens = worded(license_scan.TEMPLATES[label], rng)
        own = [w for w, _ in tokens]
        assert labels(["before", *own, "after"]) == {label}
        assert labels([w.upper() + rng.choice([",", ".", "\n"]) for w in own]) == {label}
        for at, (word, fixed) in enumerate(tokens):
            if fixed:
                assert not labels(own[:at] + ["altered"] + own[at + 1 :]), (at, word)
                if at + 1 < len(own) and own[at + 1] != word and tokens[at + 1][1] and at and tokens[at - 1][1]:
                    assert label not in labels(own[:at] + own[at + 1 :]), (at, word)


def test_gnu_notices():
    notice = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    scanner = license_scan.Scanner()
    for kind, version, label in (("", "3", "gpl-3.0"), ("", "2", "gpl-2.0"), ("Lesser ", "2.1", "lgpl"), ("Lesser ", "3", "lgpl")):
        found = scanner.scan(notice.format("program", kind, version).encode())["matches"]
        assert {m["label"] for m in found if m["kind"] == "template"} == {label}


def test_whole_texts_as_templates():
    rng = random.Random(8)
    texts = {f"long-{i}": prose(rng, 4000, "abcdef") for i in range(3)}
    scanner = license_scan.Scanner(license_scan.text_templates(texts), {})
    for label, text in texts.items():
        found = text.split()
        assert [(m["label"], m["start_word"], m["end_word"]) for m in scanner.scan(f"x {text} y".encode())["matches"]] == [(label, 1, 4001)]
        at = rng.randrange(4000)
        assert not scanner.scan(" ".join(found[:at] + found[at + 1 :]).encode())["matches"]


def test_licenses_of_odd_rows(spark):
    """Null ids, repeated rows, clashing columns and a long text that repeats a notice."""
    long = " ".join(list(NOTICES)[:6] * 3000)
    rows = [(None, "the MIT license", "own"), (1, long, "own"), (1, long, "own"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = license_scan.license_digest(license_scan.license_scan(docs)).collect()
    every = "apache,apache-2.0,cc-by,cc-by-nc,gpl,gpl-3.0,mit,mit-notice"
    assert sorted((r["doc_id"] or 0, r["n_base"], r["labels"]) for r in got) == [(0, 0, ""), (0, 1, "mit"), (1, 12000, every), (1, 12000, every)]


def test_no_licenses(no_docs):
    assert license_scan.license_digest(license_scan.license_scan(no_docs)).count() == 0
