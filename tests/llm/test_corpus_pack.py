"""Best-fit packing: exact round trip and tight bins."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabcast.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check_layout(pieces, capacity):
    """Bins are gapless from 0 and within capacity; returns the number of bins."""
    bins = {}
    for r in pieces:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [4096, 100, 7])
def test_round_trip(docs, rows, tokenizer, capacity):
    got = packing.pack(docs, PATH, capacity=capacity, slack=min(8, capacity // 10)).collect()
    check_layout(got, capacity)
    ids = {}
    for r in rows:
        own = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for n, i in enumerate(range(0, len(own), capacity)):
            some = np.array(own[i : i + capacity], "<u4").tobytes()
            key = (r[0], n, i, len(some) // 4, zlib.crc32(some))
            ids[key] = ids.get(key, 0) + 1
    found = {}
    for r in got:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        found[key] = found.get(key, 0) + 1
    assert found == ids


def test_few_bins(docs):
    got = packing.pack(docs, PATH, capacity=256).collect()
    total = sum(r["length"] for r in got)
    # One bin at most is not over half full, and most are nearly full.
    assert check_layout(got, 256) <= 1.08 * total / 256 + 1


def test_half_bins_of_many_partitions_meet(spark):
    """One short text a partition: no partition fills a bin by itself."""
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(70)], "doc_id long, text string").repartition(40)
    got = packing.pack(docs, PATH, capacity=200).collect()
    assert check_layout(got, 200) == -(-70 // (200 // 21))


def test_best_fit():
    bins, at, fill = packing.best_fit(np.array([4, 8, 1, 4, 2, 1]), 10)
    assert sorted(fill.tolist()) == [10, 10]
    assert packing.best_fit(np.array([], np.int64), 10)[2].tolist() == []
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 500)
    bins, at, fill = packing.best_fit(sizes, 100)
    assert np.bincount(bins, sizes).astype(int).tolist() == fill.tolist()
    assert (fill <= 100).all() and (2 * fill <= 100).sum() <= 1


def test_parts_of_texts(tokenizer):
    texts = ["", " ", "Don't  STOP\n\nnow", "a\x01b \x01 c\x01", "é ñ Übung 東京 a b c\x85d\x1ce", "x" * 300, "<|endoftext|> and <|startoftext|>x", "İstanbul ΑΣ Σ 1234 ...!!"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    coder = packing.Encoder(PATH)
    assert coder.ids([t.encode() for t in texts]) == want
    assert coder.ids([t.encode() for t in reversed(texts)]) == want[::-1]


def test_kept_parts_are_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "KEPT", 2)
    coder = packing.Encoder(PATH)
    for text in ("one two three", "four five " + "y" * 100, "one two"):
        assert coder.ids([text.encode()]) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert all(len(p) <= packing.KEPT_BYTES for p in coder.kept)


def test_nothing_to_pack(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
