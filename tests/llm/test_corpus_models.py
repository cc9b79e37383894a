"""Language ID, LM scoring and token counts: held-out accuracy and brute force."""

import math
import random
from collections import Counter

import public_tokenizers
import pytest

from tabcast.llm import language_id, lm_score, token_counts, words

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SYLLABLES = {"aa": ["ka", "to", "mi", "ra", "ne"], "bb": ["sch", "ung", "ein", "ver", "ö"], "cc": ["eau", "oi", "qué", "le", "ç"]}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = [(i, spoken(rng, lang, rng.randint(5, 80)), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    wrong = [(1000 + i, spoken(rng, "aa", 40), "bb") for i in range(6)]
    return spark.createDataFrame(rows + wrong + [(2000, "no label here", None), (2001, None, "aa")], "doc_id long, text string, lang string")


def test_language(labelled):
    contents = language_id.train(labelled.where("doc_id % 2 = 0"))
    assert sorted(contents) == sorted(SYLLABLES)
    tested = labelled.where("doc_id % 2 = 1 and doc_id < 1000")
    got = language_id.identify(tested, contents).join(labelled, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) <= 0.03 * len(got)


def test_language_without_letters(docs, rows, labelled):
    contents = language_id.train(labelled)
    found = language_id.identify(docs, contents).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for r in rows:
        if r[0] is None:
            continue
        if not language_id.letters(r[1] or ""):
            assert (got[r[0]]["lang_pred"], got[r[0]]["score"], got[r[0]]["rejected"]) == ("und", 0.0, True)
        else:
            assert got[r[0]]["lang_pred"] in SYLLABLES
    kept = language_id.accepted(docs, contents)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.where("doc_id is not null").collect()} == {i for i, r in got.items() if not r["rejected"]}


def test_language_narrow_margin(labelled):
    contents = language_id.train(labelled)
    judge = language_id.Classifier(contents, margin=10.0)
    assert judge.classify(spoken(random.Random(1), "aa", 30))[2]
    assert judge.classify("12 ² ½ !") == ("und", 0.0, True)
    same = language_id.Classifier({"x": b"some text of one language", "y": b"some text of one language"})
    assert same.classify("some text") == ("x", 0.0, True)


def test_language_sample_is_bounded(labelled):
    contents = language_id.train(labelled, sample=5, share_bytes=50, dict_bytes=200, languages=2)
    assert len(contents) == 2 and all(len(c) <= 200 for c in contents.values())


def test_language_sample_follows_texts_not_rows(spark):
    """Many copies of one page do not crowd out the other texts of a language."""
    rng = random.Random(5)
    own, page = [spoken(rng, "aa", 40) for _ in range(50)], spoken(rng, "aa", 40)
    rows = [(t, "aa") for t in own] + [(spoken(rng, "bb", 40), "bb") for _ in range(60)]
    copies = spark.range(20_000).selectExpr(f"'{page}' AS text", "'aa' AS lang")
    contents = language_id.train(spark.createDataFrame(rows, "text string, lang string").union(copies))
    assert sum(language_id.letters(t).encode() in contents["aa"] for t in own) >= 45


def test_language_nothing_learnt(no_docs, docs):
    assert language_id.train(no_docs) == {}
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.identify(no_docs, {"a": b"abc"}).count() == 0


def slow_losses(texts, marked, size, prior):
    """(n, background, target) of each text, from dictionaries."""
    split = [[w.decode() for w in words.lower_words((t or "").encode())] for t in texts]
    top = Counter(w for s in split for w in s)
    vocab = {w for w, _ in sorted(top.items(), key=lambda x: (-x[1], x[0].encode()))[:size]}
    split = [[w if w in vocab else None for w in s] for s in split]
    out = []
    for use in ([True] * len(texts), marked):
        pairs = Counter(p for s, u in zip(split, use) if u for p in zip([None, *s], s))
        of_word, of_history = Counter(), Counter()
        for (h, w), n in pairs.items():
            of_word[w] += n
            of_history[h] += n
        total, kinds = sum(of_word.values()), len(vocab) + 1

        def loss(h, w):
            single = (of_word[w] + 1) / (total + kinds)
            return -math.log((pairs[h, w] + prior * single) / (of_history[h] + prior))

        out.append([sum(loss(h, w) for h, w in zip([None, *s], s)) / len(s) if s else None for s in split])
    return list(zip(map(len, split), *out))


@pytest.mark.parametrize("size", [10, 2047])
def test_lm_scores(spark, docs, rows, size):
    targets = spark.createDataFrame([(i,) for i in (1, 4, 7, 7, 15, 40, None, 99999)], "doc_id long")
    marked = [r[0] in (1, 4, 7, 15, 40) for r in rows]
    # A vocabulary of the whole corpus is known exactly only without rows beyond it; size cuts it alike.
    want = {(r[0], n): (b, t) for r, (n, b, t) in zip(rows, slow_losses([r[1] for r in rows], marked, size, 20.0))}
    got = lm_score.cross_entropy_difference(docs, targets, size=size).collect()
    assert len(got) == len(rows)
    for r in got:
        b, t = want[r["doc_id"], r["n_words"]]
        if b is None:
            assert r["h_background"] is None and r["score"] is None
        else:
            assert r["h_background"] == pytest.approx(b, rel=1e-4) and r["h_target"] == pytest.approx(t, rel=1e-4)
            assert r["score"] == pytest.approx(t - b, abs=1e-3)


@pytest.mark.parametrize(("hot", "bucket_words"), [(2047, 2_000_000), (20, 50)])
def test_lm_counts_every_word(spark, docs, rows, hot, bucket_words):
    """All words are told apart, whether their pairs stay or move."""
    marked = [r[0] in (1, 4, 7, 15, 40) for r in rows]
    targets = spark.createDataFrame([(i,) for i in (1, 4, 7, 15, 40)], "doc_id long")
    want = {(r[0], n): (b, t) for r, (n, b, t) in zip(rows, slow_losses([r[1] for r in rows], marked, 10**9, 20.0))}
    got = lm_score.cross_entropy_difference(docs, targets, hot=hot, bucket_words=bucket_words).collect()
    assert len(got) == len(rows)
    for r in got:
        b, t = want[r["doc_id"], r["n_words"]]
        assert (r["h_background"] is None) == (b is None)
        if b is not None:
            assert r["h_background"] == pytest.approx(b, rel=1e-4) and r["h_target"] == pytest.approx(t, rel=1e-4)


def test_lm_rare_words_tell(spark):
    """Documents that differ only in words beyond the frequent ones have different scores."""
    common = " ".join(f"w{i}" for i in range(3000)) + " "
    rows = [(0, common * 3), (1, common * 3), (2, "rare own words " * 3), (3, "w1 w2 rare own words"), (4, "w1 w2 other new terms")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(docs, docs.where("doc_id = 2").select("doc_id")).collect()}
    assert got[3] < got[4] - 0.1


def test_lm_tells_the_target(spark):
    rng = random.Random(8)
    rows = [(i, spoken(rng, "aa" if i % 2 else "bb", 50)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    targets = docs.where("doc_id % 2 = 1 and doc_id < 100").select("doc_id")
    got = lm_score.cross_entropy_difference(docs, targets).where("doc_id >= 100").collect()
    assert max(r["score"] for r in got if r["doc_id"] % 2) < min(r["score"] for r in got if not r["doc_id"] % 2)


def test_lm_without_targets(docs, no_docs):
    got = lm_score.cross_entropy_difference(docs, no_docs.select("doc_id")).where("n_words > 0")
    assert got.where("score is null").count() == 0
    assert lm_score.cross_entropy_difference(no_docs, no_docs.select("doc_id")).count() == 0


def slow_tokens(word, pieces, byte):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + n * byte, best[end - 1][1] + n)]
        ways += [(best[s][0] + pieces[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in pieces]
        best.append(max(ways, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


def test_tokens(docs, rows):
    pieces = token_counts.load_pieces(PIECES)
    assert sum(map(math.exp, pieces.values())) == pytest.approx(1)
    byte = min(pieces.values()) - 1.0
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, PIECES).collect())
    known = {}
    want = Counter()
    for r in rows:
        found = [w.decode() for w in words.space_words((r[1] or "").encode())]
        for w in set(found) - known.keys():
            known[w] = slow_tokens(token_counts.MARK + w, pieces, byte)
        want[r[0], len(found), sum(known[w] for w in found)] += 1
    assert got == want


def test_trie_shares_prefixes():
    pieces = {"a": -1.0, "ab": -1.5, "abc": -1.8, "bc": -0.4, "c": -3.0}
    fresh = ["abc", "abcb", "ab", "a", "", "zzz", "abç", "abcabcabc"]
    byte = min(pieces.values()) - 1
    assert token_counts.Trie(pieces).counts(fresh) == {w: slow_tokens(w, pieces, byte) for w in fresh}


def test_tokens_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 3)
    counter = token_counts.Counter(token_counts.load_pieces(PIECES))
    texts = [b"one two three four five", b"six seven " + b"x" * 500, b"one two"]
    whole = token_counts.Counter(token_counts.load_pieces(PIECES)).count(texts)
    assert [counter.count([t])[0] for t in texts] == whole


def test_no_tokens(no_docs):
    assert token_counts.token_counts(no_docs, PIECES).count() == 0
