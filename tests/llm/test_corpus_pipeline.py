"""The registered corpus queries and the pipeline on the smallest tables."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_corpus_edit import lines_left
from test_corpus_simhash import slow_components, slow_fingerprint
from tokenizers import Tokenizer

import __spark_entry__ as job
import corpus_pipeline
from tabcast.llm import decontaminate, language_id, line_dedup, queries, simhash, words

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_one_query_an_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(job.queries())


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == columns, name
        counts.append(after.count())
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert counts == sorted(counts, reverse=True)
    # Most documents are clean.
    assert counts[-1] > 0.6 * counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert last.select("doc_id").distinct().count() == counts[-1]


def test_long_runs_leave_small_plans(spark):
    """The stage of line dedup takes 400 common lines, and its plan estimates sizes of few digits."""
    text = "\n".join(f"line {i}" for i in range(400))
    docs = spark.createDataFrame([(i, f"own {i}\n{text}", 0) for i in range(3)], "doc_id long, text string, n_chars long")
    less = corpus_pipeline.remove_repeated_lines(spark, docs, FOLDER)
    plan = less._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    # Of whole texts and their cuts; the latter come from all depths.
    assert plan.children().last().stats().sizeInBytes() < 1 << 63
    assert {r["doc_id"]: r["text"] for r in less.collect()} == {0: f"own 0\n{text}", 1: "own 1", 2: "own 2"}


def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)


def leaks(text, items, index):
    """Whether a text overlaps an item on any diagonal, with or without a seed hit."""
    own = words.word_hashes(words.folded_words(text.encode()))
    for item in items:
        if len(item) < decontaminate.MIN_ITEM:
            continue
        rows, columns = np.nonzero(own[:, None] == item[None, :])
        shifts, agree = np.unique(rows - columns, return_counts=True)
        enough = min(decontaminate.MIN_WORDS, decontaminate.SHARE * len(item))
        if any(index.overlap(own, item, int(shift)) for shift in shifts[agree >= enough]):
            return True
    return False


def test_run_against_brute_force(spark):
    """The pieces that come out are those of the documents that plain Python keeps."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    judge = language_id.Classifier(language_id.train(docs))
    kept = [(r["doc_id"], r["text"]) for r in docs.collect() if not judge.classify(r["text"])[2]]
    less = lines_left(kept, line_dedup.MIN_LINES, line_dedup.MIN_WORDS)
    texts = {ident: less[ident, text] for ident, text in kept}
    prints = {ident: slow_fingerprint(text, 3) for ident, text in texts.items()}
    roots = slow_components(prints.values())
    first = {}
    for ident in sorted(texts):
        first.setdefault(roots[prints[ident]], ident)
    items = [words.word_hashes(words.folded_words(r["text"].encode())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = [ident for ident in first.values() if not leaks(texts[ident], items, decontaminate.Index())]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for ident in clean:
        ids = tokenizer.encode(texts[ident], add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            some = np.array(ids[at : at + 4096], "<u4").tobytes()
            want.add((ident, n, at, len(some) // 4, zlib.crc32(some)))
    got = [tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "start", "length", "ids_crc32").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_near_copies_are_left(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = simhash.keep_one(docs)
    groups = simhash.simhash_groups(kept)
    assert groups.select("root").distinct().count() == kept.count()


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_nothing(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, FOLDER).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, stage):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None), (None, "ein Wort und noch eins", "de", None, 3), (2, "some words " * 2000, "en", "s", 22000)]
    got = corpus_pipeline.STAGES[stage][1](spark, spark.createDataFrame(rows, schema), FOLDER)
    assert got.count() >= 1
