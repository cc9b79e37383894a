"""Line and document quality rules against plain Python."""

import random
import re

import pytest

from tabcast.llm import line_quality


def slow_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words by their definitions."""
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    places = {}
    for i, w in enumerate(windows):
        places.setdefault(w, []).append(i)
    under = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(under)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_facts(docs, rows):
    got = line_quality.assess(docs).select("row.doc_id", "row.text", "found.*").collect()
    assert len(got) == len(rows)
    for r in got:
        want = slow_base(r["text"])
        assert tuple(r[n] for n in BASE) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_repeated_words_random():
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join(rng.choice(["a", "b", "é", "cc"][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 90)))
        assert line_quality.repeated_words(text.encode().split()) == slow_base(text)[4]


PROSE = "This line is prose and it ends as it should."


@pytest.mark.parametrize(("line", "rule"), [
    (PROSE, None),
    ("It goes on after a stop. But this half has none", None),
    ("“She said so.”", None),
    ("这是一句话。后面还有", None),
    ("A heading without an end", "n_no_punctuation"),
    ("words### with%%% marks$$$ at&&& each*** end.", "n_no_punctuation"),
    ("Home · About · Team · Jobs.", "n_navigation"),
    ("- an item of a list, with more words than marks.", None),
    ("Sign in or register.", "n_navigation"),
    ("He had to sign in at the desk before he could see any of them.", None),
    ("Designs inhabit these places.", None),
    ("By browsing on you agree: we use  cookies.", "n_boilerplate"),
    ("© 2020 Nobody. ALL RIGHTS RESERVED.", "n_boilerplate"),
])
def test_rules_of_a_line(line, rule):
    facts, clean = line_quality.judge(f"{PROSE[:4]} begins.\n{line}".encode())
    counted = {n: getattr(facts, n) for n in ("n_no_punctuation", "n_navigation", "n_boilerplate")}
    assert counted == {n: int(n == rule) for n in counted}
    assert clean.decode() == "This begins." + ("" if rule else f"\n{line}")
    assert facts.lost_chars == (len(re.sub(r"\s", "", line)) if rule else 0)


def test_later_copies_and_blank_lines():
    facts, clean = line_quality.judge("One.\n\nOne.\n \nTwo.\nOne. ".encode())
    assert (facts.n_lines, facts.n_dup_lines, facts.n_failed_lines) == (4, 1, 1)
    assert clean.decode() == "One.\n\n \nTwo.\nOne. "


def test_documents_that_lose_too_much(spark):
    prose = "\n".join(f"Line {i} is plain. " + " ".join(f"word{i}{k}" for k in range(12)) for i in range(4))
    menu = "\n".join(f"Item {i} | Other | More | Last" for i in range(9))
    rows = [(1, prose), (2, f"{prose}\nA title"), (3, f"{menu}\n{prose}"), (4, None), (5, ""), (6, menu)]
    docs = spark.createDataFrame([(*r, "own", True) for r in rows], "doc_id long, text string, found string, kept boolean")
    got = {r["doc_id"]: r for r in line_quality.cleaned(docs).collect()}
    assert set(got) == {1, 2} and got[1]["text"] == got[2]["text"] == prose and got[1]["found"] == "own"
    assert line_quality.cleaned(docs, max_lost=100).count() == 4
    assert line_quality.cleaned(docs, max_lost=100, min_words=0).count() == 6


def test_empty_and_repeated(docs, no_docs):
    assert line_quality.assess(no_docs).count() == 0 and line_quality.cleaned(no_docs).columns == no_docs.columns
    seen = {}
    for r in line_quality.assess(docs).collect():
        assert seen.setdefault(r["row"], r["found"]) == r["found"]
