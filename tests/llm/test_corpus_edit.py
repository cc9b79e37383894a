"""Line dedup and substring dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tabcast.llm import line_dedup, substring_dedup, words


def rank(row):
    ident = row[0]
    return (ident is None, ident if ident is not None else 0)


def lines_left(rows, depth, n_words):
    """Texts by distinct (id, text) after the later copies of runs of ``depth`` non-blank lines or ``n_words`` words are gone."""
    distinct = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (rank(r), r[1]))
    places, gone = defaultdict(list), defaultdict(set)
    for key in distinct:
        own = [(i, line.strip(" \t\r\f\v")) for i, line in enumerate(key[1].split("\n"))]
        own = [x for x in own if x[1]]
        # Two lines tell whether the blank ones between them go.
        for size in range(1, max(depth, 2) + 1):
            for p in range(len(own) - size + 1):
                run = tuple(x[1] for x in own[p : p + size])
                if size >= depth or sum(len(words.space_words(x.encode())) for x in run) >= n_words:
                    places[run].append((key, own[p][0], own[p + size - 1][0]))
    for found in places.values():
        for key, first, last in sorted(found, key=lambda x: (rank(x[0]), x[0][1], x[1]))[1:]:
            gone[key].update(range(first, last + 1))
    return {k: "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in gone[k]) for k in distinct}


@pytest.mark.parametrize(("depth", "n_words"), [(1, 10), (2, 10), (2, 6), (3, 10), (5, 14), (2, 10**6)])
def test_lines(docs, rows, depth, n_words):
    # Ids are unique wherever a first place could be disputed, but for null ids: these rank last.
    kept = line_dedup.deduplicated(docs, min_lines=depth, min_words=n_words, name="kept").collect()
    want = lines_left(rows, depth, n_words)
    assert len(kept) == len(rows)
    for r in kept:
        assert r["kept"] == (None if r["text"] is None else want[(r["doc_id"], r["text"])])
        assert r["row"] in ("own", None)


def test_lines_replace_the_text(docs):
    got = line_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert got.count() == docs.count()


def test_maximal_runs(spark):
    text = "a\nb\nc\nd"
    docs = spark.createDataFrame([(1, f"x\n{text}\ny"), (2, f"z\n\n{text}\nw"), (3, "b\nc")], "doc_id long, text string")
    runs = line_dedup.maximal_runs(line_dedup.copies(docs)).collect()
    assert {tuple(r) for r in runs} == {(2, 2, 5, 1, 1), (3, 0, 1, 1, 2)}


def test_doubling_ends_with_the_longest_run(spark):
    """Depths double until no rank is shared, and a run of 21 lines comes out whole although its tail has an earlier place."""
    text = "\n".join(f"line {i}" for i in range(21))
    docs = spark.createDataFrame([(1, "line 19\nline 20"), (2, text), (3, f"own\n{text}\nend")], "doc_id long, text string")
    levels = [(depth, rows.select("rank", "pos").collect()) for depth, rows in line_dedup.intervals(docs)]
    assert [depth for depth, _ in levels] == [1, 2, 4, 8, 16]
    # Ranks are places in the suffix array: groups of equal rank lie end to end.
    for _, rows in levels:
        sizes = Counter(r["rank"] for r in rows)
        at = 0
        for place in sorted(sizes):
            assert place == at
            at += sizes[place]
    assert len(levels[-1][1]) == 2 * (21 - 16 + 1)
    runs = {tuple(r) for r in line_dedup.maximal_runs(line_dedup.copies(docs)).collect()}
    assert runs == {(2, 19, 20, 1, 0), (3, 1, 21, 2, 0)}


def test_size_estimates_stay_small(spark):
    """The planner's estimate of a depth's size has no more digits than that of the depth before."""
    text = "\n".join(f"line {i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"own {i}\n{text}") for i in range(3)], "doc_id long, text string")
    levels = [(depth, rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for depth, rows in line_dedup.intervals(docs)]
    assert [depth for depth, _ in levels] == [1, 2, 4, 8, 16]
    assert all(size < 1 << 63 for _, size in levels)


def test_long_single_lines_go(spark):
    long, short = "one line of more than ten words that many pages share", "Released under the same terms."
    docs = spark.createDataFrame([(i, f"{short}\nown {i}\n{long}\nalso own {i}\n{short}") for i in range(300)] + [(400, long), (401, short)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()}
    assert long in got[0] and got[400] == "" and got[401] == short
    assert all(got[i] == f"{short}\nown {i}\nalso own {i}\n{short}" for i in range(1, 300))


@pytest.mark.parametrize(("adaptive", "parts", "together"), [("true", 8, 2), ("false", 3, 3), ("true", 211, 2), ("true", 8, 0)])
def test_hot_ranks_apart(spark, docs, rows, monkeypatch, adaptive, parts, together):
    """Hot ranks are broadcast and the others joined by a shuffle, with the same rows; some, or all, are hot here."""
    monkeypatch.setattr(line_dedup, "_TOGETHER", together)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        kept = line_dedup.deduplicated(docs, name="kept").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = lines_left(rows, line_dedup.MIN_LINES, line_dedup.MIN_WORDS)
    assert all(r["kept"] == (None if r["text"] is None else want[(r["doc_id"], r["text"])]) for r in kept)


def test_overlapping_copies_keep_the_first(spark):
    docs = spark.createDataFrame([(1, "a\nb\na\nb\na\nb")], "doc_id long, text string")
    assert [r["text"] for r in line_dedup.deduplicated(docs).collect()] == ["a\nb"]


def test_no_lines(no_docs):
    assert line_dedup.deduplicated(no_docs).count() == 0


def substrings(rows, width):
    """(words, removed, hash of kept words) by (id, text)."""
    split = [(r[0], r[1], words.space_words((r[1] or "").encode())) for r in rows]
    times = Counter(tuple(w[p : p + width]) for _, _, w in split for p in range(len(w) - width + 1))
    out = {}
    for ident, text, w in split:
        gone = set()
        for p in range(len(w) - width + 1):
            if times[tuple(w[p : p + width])] > 1:
                gone.update(range(p, p + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[ident, text] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize(("width", "prefix", "tree"), [(35, 6, 1000), (35, 6, 1), (12, 5, 1000), (12, 5, 2)])
def test_substrings(docs, rows, width, prefix, tree):
    """``tree`` = 1 sends every branching group down the path for large groups."""
    found = substring_dedup.deduplicated(docs, width=width, prefix=prefix, tree=tree, digest=True)
    want = substrings(rows, width)
    assert sorted(tuple(r)[1:] for r in found.collect()) == sorted(want[r[0], r[1]] for r in rows)
    by_id = {r["doc_id"]: tuple(r)[1:] for r in found.collect() if r["doc_id"] is not None}
    assert by_id == {r[0]: want[r[0], r[1]] for r in rows if r[0] is not None}
    assert any(0 < x[1] < x[0] for x in by_id.values())


def test_repeats_within_one_document(spark):
    period = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"start {period} {period} {period} end"), (2, "w " * 40)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.deduplicated(docs).collect()}
    assert got == {1: (62, 60, "start end"), 2: (40, 40, "")}


def test_kept_words_are_text(docs):
    assert substring_dedup.deduplicated(docs).where("kept is null").count() == 0


def test_no_substrings(no_docs):
    assert substring_dedup.deduplicated(no_docs).count() == 0
