"""Spelling variants: bounds, lists and results against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from tabcast.llm import spelling


def slow_words(rows, damage=31, least=7):
    found = Counter()
    for ident, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * n else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return sorted((w, forms[w] or "", root(w), n, len(near[w]), counts[forms[w]] if forms[w] else 0) for w, n in counts.items())


def result(frame):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in frame.collect())


def texts_of(seed, alphabet="abcé", words=500):
    """Families of words of very different frequency, a few edits apart."""
    rng = random.Random(seed)
    pool = []
    for _ in range(words // 10):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(7, 11)))
        pool.append((word, 400))
        for weight in (40, 30, 4, 3, 2, 1, 1):
            i = rng.randrange(len(word) + 1)
            word = rng.choice([word[:i] + rng.choice(alphabet) + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice(alphabet) + word[i + 1 :]])
            pool.append((word, weight))
    names, weights = zip(*pool)
    return [(i, rng.choice([" ", "\n", "1", "-"]).join(w.title() if rng.random() < 0.1 else w for w in rng.choices(names, weights, k=900))) for i in range(20)]


@pytest.mark.parametrize("limits", [(2048, 2048, 20), (3, 2, 4), (3, 2048, 100_000)], ids=str)
def test_variants(spark, monkeypatch, limits):
    """Also with every list split, tiles of two words, and a dictionary of pairs of characters alone."""
    for name, value in zip(("LIST", "_TILE", "GRAM_WORDS"), limits):
        monkeypatch.setattr(spelling, name, value)
    if limits[0] == 3:
        monkeypatch.setattr(spelling, "SPLITS", 10**9)
    rows = texts_of(limits[1])
    docs = spark.createDataFrame([(*r, "own", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(7)
    want = slow_variants(slow_words(rows))
    got = result(spelling.variants(docs))
    assert got == want
    assert sum(f != "" for _, f, *_ in want) > 20 and any(r not in (w, f) for w, f, r, *_ in want)


def test_shared_corpus(docs, rows):
    assert result(spelling.variants(docs, damage=2)) == slow_variants(slow_words([r[:2] for r in rows], 2))


def dictionaries(rng):
    alphabet = rng.choice(["ab", "abc", "abcdefgh"])
    names = ["".join(rng.choice(alphabet) for _ in range(rng.randint(7, 12))) for _ in range(50)]
    counts = Counter(g for w in names for g in {w[i : i + q] for q in (2, 3, 4) for i in range(len(w) - q + 1)})
    least = rng.choice([2, 5, 12])
    return alphabet, names, spelling.Dictionary({g: n for g, n in counts.items() if n >= least})


def edits(rng, word, alphabet):
    i, c = rng.randrange(len(word)), rng.choice(alphabet)
    return rng.choice([word[:i] + c + word[i:], word + c, word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


def test_bounds_of_affected_grams():
    """A near word shares at least as many grams, in place, as the bound of either says."""
    rng = random.Random(2)
    for _ in range(120):
        alphabet, names, dictionary = dictionaries(rng)
        for word in names:
            other = edits(rng, word, alphabet)
            a, b = dictionary.decompose(word), dictionary.decompose(other)
            shift = len(other) - len(word)
            front = next((i for i, (x, y) in enumerate(zip(word, other)) if x != y), min(len(word), len(other)))
            shared = max(
                sum((p if p < cut else p + shift, g) in b for p, g in a)
                for cut in range(max(0, front - 8), len(word) + 1)
            )
            assert shared >= max(len(a) - dictionary.affected(word, a), len(b) - dictionary.affected(other, b))


def test_near_words_meet_in_a_list():
    rng = random.Random(3)
    met = 0
    for _ in range(150):
        alphabet, names, dictionary = dictionaries(rng)
        plain = spelling.Dictionary({g: n for g, n in dictionary.counts.items() if len(g) == 2})
        for word in names:
            other = edits(rng, word, alphabet)
            if other == word or len(other) < 7:
                continue
            a, b = sorted((word, other), key=len)
            left, right = (spelling.entries_of(w, dictionary, plain) for w in (a, b))
            sides = (spelling.SAME, spelling.SAME) if len(a) == len(b) else (spelling.SHORTER, spelling.LONGER)
            assert {k for k, side in left if side == sides[0]} & {k for k, side in right if side == sides[1]}
            met += 1
    assert met > 5000


def test_signatures():
    """One edit changes at most two bits, also of a part of a column."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    names = ["".join(rng.choice("abzÀéÿ÷") for _ in range(rng.randint(7, 30))) for _ in range(400)]
    a, b = (spelling.signatures(pa.array(["begin", *x]).slice(1)) for x in (names, [edits(rng, w, "abzÀéÿ÷") for w in names]))
    assert np.bitwise_count(a ^ b).max() == 2
    assert a[3] == spelling.signatures(pa.array([names[3]]))[0]


def test_long_words():
    """Work on a word grows with its length, not its square."""
    rng = random.Random(5)
    word = "".join(rng.choice("abc") for _ in range(40_000))
    _, _, dictionary = dictionaries(rng)
    assert len(spelling.entries_of(word, dictionary, dictionary)) < 60


def test_hot_list(spark):
    """A third of the vocabulary shares its rarest grams."""
    rng = random.Random(6)
    counts = {"".join(rng.choice("abcd") for _ in range(3)) + "xyzxyz" + "".join(rng.choice("abcd") for _ in range(3)): 2 for _ in range(2600)}
    counts |= {"".join(rng.choice("efghijklm") for _ in range(9)): 2 for _ in range(2000)}
    spread = spelling.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n long"))
    got = sorted((r["word"], r["near"]) for r in spread.collect())
    rests = {}
    for w in counts:
        for i in range(len(w)):
            rests.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    want = {(a, b) for group in rests.values() for a in group for b in group if a != b}
    assert got == sorted(want)


def test_empty(spark, no_docs):
    assert spelling.variants(no_docs).count() == 0
    alone = spark.createDataFrame([(1, "lonesome lonesome"), (None, None), (2, "short short")], "doc_id long, text string")
    assert result(spelling.variants(alone, damage=0)) == [("lonesome", "", "lonesome", 2, 0, 0)]
