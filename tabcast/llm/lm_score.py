"""Cross-entropy difference of target and background bigram models.

Both models share one vocabulary: every word of all documents, or only the
``size`` most frequent and one class for all others, if a size is given. The
background model counts every document, the target model those marked as
target. A document's score is the mean over its words of the loss under the
target model less the loss under the background model: the lower, the more
like the target.

A bigram's probability is interpolated with the unigram's, which is counted
with one added: (c(h, w) + s * p(w)) / (c(h) + s).

A pair (h, w) takes one of two ways. The few most frequent words are hot:
pairs of two hot words are summed in each task, and their losses, bounded by
``hot`` squared, are broadcast. All other pairs move once, as each document's
distinct pairs, to a bucket named by the hash of w (of both words if w is
hot), of which there are the more the more words were counted. A bucket thus
holds every count of its words and pairs, and gives sums by document. As the
words that name buckets are not hot, no bucket can hold more than its share.

Words are told apart by 64-bit hash. They are runs without white space, A-Z
in lower case. The word before the first is the class of others.

Defined cases: null and empty texts have 0 words and null losses and score.
A document is target if any of its labels says so; labels with null ids mark
none. Without a target document the target model is its prior, uniform. Rows
that repeat id and text are counted each, and scored alike.
"""

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.llm import words
from tabcast.operators.order import checkpoint_folder, materialise

# Words whose pairs with each other are counted in every task; all others move.
HOT = 2_047
PRIOR = 20.0
# Words a task counts before it emits its sums.
_HELD = 200_000
# Words of documents whose pairs are cut and sorted in one go.
_TOGETHER = 1 << 20
# Counted words for each bucket, and the least number of buckets.
_BUCKET_WORDS = 2_000_000
_BUCKETS = 64
# Documents that are cut together at most.
_DOCS = 1 << 16
# Smaller than any hash: numbers of hot words, and a mark in place of the word before at a document's last word.
_CODES = 1 << 16
_LAST = np.uint64(_CODES - 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    seen: Counter = Counter()
    for batch in batches:
        for raw in words.raw_texts(batch.column(0)):
            seen.update(words.lower_words(raw or b""))
            if len(seen) > _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], schema=schema)
                seen = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], schema=schema)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all documents."""
    counted = docs.select(docs[text_col].alias("text")).mapInArrow(_count_words, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> list[bytes]:
    """Ties go to the word first in byte order."""
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def _hashes(found: list[bytes]) -> np.ndarray:
    """Hashes of words, none of them a code."""
    return np.maximum(words.word_hashes(found), np.uint64(_CODES))


@dataclass
class Numbers:
    """Numbers of words: 1 up for hot ones, and one for all others."""

    hashes: np.ndarray
    numbers: np.ndarray
    other: int

    @classmethod
    def of(cls, vocab: list[bytes], whole: bool) -> "Numbers":
        """Words beyond the vocabulary share number 0 with the start; of a whole vocabulary they have one of their own."""
        hashes = _hashes(vocab)
        order = np.argsort(hashes)
        return cls(hashes[order], order + 1, len(vocab) + 1 if whole else 0)

    @property
    def width(self) -> int:
        return len(self.hashes) + 1 + (self.other > 0)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), self.other, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], self.other)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(keys, targets, lengths, hashes) of documents that have words, many together."""
    keys, targets, parts, held = [], [], [], 0
    for batch in batches:
        for raw, key, target in zip(words.raw_texts(batch.column("text")), batch.column("key").to_pylist(), batch.column("target").to_pylist()):
            found = words.lower_words(raw or b"")
            if not found:
                continue
            keys.append(key)
            targets.append(bool(target))
            parts.append(_hashes(found))
            held += len(found)
            if held >= _TOGETHER or len(keys) >= _DOCS:
                yield np.array(keys, np.int64), np.array(targets), np.array([len(p) for p in parts]), np.concatenate(parts)
                keys, targets, parts, held = [], [], [], 0
    if parts:
        yield np.array(keys, np.int64), np.array(targets), np.array([len(p) for p in parts]), np.concatenate(parts)


def _before(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The value before each, within its document; 0 before the first."""
    out = np.concatenate((np.zeros(1, values.dtype), values[:-1]))
    out[np.cumsum(lengths) - lengths] = 0
    return out


def _count_pairs(numbers: Numbers):
    """mapInArrow function over (key, target, text): (pair, b, t) sums of the task over numbers."""
    width = numbers.width

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("pair", pa.int64()), ("b", pa.int64()), ("t", pa.int64())])
        sums = np.zeros((2, width * width), np.int32)
        for _, targets, lengths, hashes in _chunks(batches):
            own = numbers(hashes)
            pairs = _before(own, lengths) * width + own
            for row, some in ((0, pairs), (1, pairs[np.repeat(targets, lengths)])):
                seen, n = np.unique(some, return_counts=True)
                sums[row, seen] += n.astype(sums.dtype)
        seen = np.flatnonzero(sums[0])
        for at in range(0, len(seen), 1 << 18):
            some = seen[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0, some].astype(np.int64)), pa.array(sums[1, some].astype(np.int64))], schema=schema)

    return counted


@dataclass
class Models:
    """What tasks know of both models (background, target): losses of pairs of hot words, and parts of the others'."""

    numbers: Numbers
    pairs: np.ndarray  # -log(c(h, w) + s * p(w)) by number of h and w
    history: np.ndarray  # log(c(h) + s) by number of h
    counts: np.ndarray  # c(w) by number of w
    totals: np.ndarray  # words and kinds of words
    prior: float

    @classmethod
    def fit(cls, numbers: Numbers, pairs: np.ndarray, counts: list[np.ndarray], kinds: int, prior: float) -> "Models":
        """``counts`` of ``pairs`` for both models; ``kinds`` of words, with the class of others."""
        width = numbers.width
        table = np.zeros((2, width * width), np.float32)
        history, of_word, totals = np.empty((2, width)), np.empty((2, width)), np.empty(2)
        for k, n in enumerate(counts):
            of_word[k] = np.bincount(pairs % width, n, width)
            history[k] = np.log(np.bincount(pairs // width, n, width) + prior)
            totals[k] = of_word[k].sum() + kinds
            # Pairs that no document has are never asked for.
            table[k, pairs] = -np.log(n + prior * (of_word[k][pairs % width] + 1) / totals[k])
        return cls(numbers, table, history, of_word, totals, prior)


_BLOBS = ("w", "h", "rare", "doc", "n", "keys", "targets", "own", "own_n", "own_b", "own_t")


def _deal(held, buckets: int):
    """mapInArrow function over (key, target, text): a row of arrays for each bucket of each chunk.

    ``w``, ``h``, ``doc`` (a place in ``keys``) and ``n`` are pairs with a word
    that is not hot; ``h`` has numbers, and ``rare`` the hashes of those that
    are not hot. ``own`` are documents with the sums of their hot pairs.
    """
    schema = pa.schema([("bucket", pa.int32()), *((name, pa.binary()) for name in _BLOBS)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        numbers, width = models.numbers, models.numbers.width
        rare = numbers.other or width
        for keys, targets, lengths, hashes in _chunks(batches):
            doc = np.repeat(np.arange(len(keys)), lengths)
            own = numbers(hashes)
            before = _before(own, lengths)
            coded = np.where(before == rare, _before(hashes, lengths), before.astype(np.uint64))
            moves = (own == rare) | (before == rare)
            losses = [
                np.bincount(doc, np.where(moves, 0, models.pairs[k][before * width + own]) + np.where(before == rare, 0, models.history[k][before]), len(keys))
                for k in (0, 1)
            ]
            ends = np.cumsum(lengths) - 1
            ends = ends[own[ends] == rare]
            w, h = np.concatenate((hashes[moves], hashes[ends])), np.concatenate((coded[moves], np.full(len(ends), _LAST)))
            at, hot = np.concatenate((doc[moves], doc[ends])), np.concatenate((own[moves], own[ends])) != rare
            bucket = (words.mixed(np.where(hot, w * np.uint64(3) + h, w)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((at, h, w, bucket))
            w, h, at, bucket = w[order], h[order], at[order], bucket[order]
            first = np.ones(len(w), bool)
            first[1:] = (at[1:] != at[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1])
            first = np.flatnonzero(first)
            n = np.diff(np.append(first, len(w)))
            w, h, at, bucket = w[first], h[first], at[first], bucket[first]
            place = (keys % buckets).astype(np.int32)
            by_place = np.argsort(place, kind="stable")
            names = np.arange(buckets + 1)
            cuts, own_cuts = np.searchsorted(bucket, names), np.searchsorted(place[by_place], names)
            rows: list[tuple] = []
            for b in range(buckets):
                some, mine = slice(cuts[b], cuts[b + 1]), by_place[own_cuts[b] : own_cuts[b + 1]]
                if cuts[b] == cuts[b + 1] and not len(mine):
                    continue
                docs, local = np.unique(at[some], return_inverse=True)
                arrays = (
                    w[some], np.where(h[some] < _CODES, h[some], rare).astype(np.uint16), h[some][h[some] >= _CODES], local.astype(np.uint16), n[some].astype(np.uint32), keys[docs], targets[docs],
                    keys[mine], lengths[mine].astype(np.int64), losses[0][mine], losses[1][mine],
                )
                rows.append((b, *(a.tobytes() for a in arrays)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return dealt


_SUMS = "key long, docs long, n long, b double, t double"


def _sum_bucket(held):
    """applyInArrow function over the rows of a bucket: sums by document."""
    kinds = dict(zip(_BLOBS, (np.uint64, np.uint16, np.uint64, np.uint16, np.uint32, np.int64, bool, np.int64, np.int64, np.float64, np.float64)))

    def summed(table: pa.Table) -> pa.Table:
        models = held.value
        read = {name: [np.frombuffer(raw, kinds[name]) for raw in table.column(name).to_pylist()] for name in _BLOBS}
        shift = np.cumsum([0, *map(len, read["keys"])])
        read["doc"] = [d.astype(np.int64) + s for d, s in zip(read["doc"], shift.tolist())]
        a = {name: np.concatenate(parts) for name, parts in read.items()}
        coded = a["h"] == models.numbers.other
        a["h"] = a["h"].astype(np.uint64)
        # Without a number for other words no pair moves.
        a["h"][coded] = a["rare"]
        keys, place = np.unique(np.concatenate((a["keys"], a["own"])), return_inverse=True)
        of_key, of_own = place[: len(a["keys"])], place[len(a["keys"]) :]
        out = [np.bincount(of_own, a[name], len(keys)).astype(float) for name in ("own_b", "own_t")]
        if len(a["w"]):
            order = np.lexsort((a["h"], a["w"]))
            w, h, doc, n = (a[name][order] for name in ("w", "h", "doc", "n"))
            last = h == _LAST
            new_word = np.concatenate(([True], w[1:] != w[:-1]))
            new_pair = new_word | np.concatenate(([True], h[1:] != h[:-1]))
            word, pair = np.cumsum(new_word) - 1, np.cumsum(new_pair) - 1
            number = models.numbers(w[new_word])
            hot = (number != models.numbers.other)[word]
            for k, times in ((0, n.astype(float)), (1, n * a["targets"][doc].astype(float))):
                ended = np.bincount(word, np.where(last, times, 0))
                counts = np.bincount(word, times) - ended
                # A hot word's pairs are dealt to many buckets; its count is known.
                of_word = np.where(hot[new_word], models.counts[k][number], counts)[word]
                single = (of_word + 1) / models.totals[k]
                loss = np.where(last, 0, -np.log(np.bincount(pair, times)[pair] + models.prior * single))
                # A word is a history wherever it is not the last.
                history = np.where(hot, 0, np.log(counts - ended + models.prior)[word])
                out[k] += np.bincount(of_key[doc], n * (loss + np.where(last, -history, history)), len(keys))
        docs, of_words = np.bincount(of_own, minlength=len(keys)), np.bincount(of_own, a["own_n"], len(keys)).astype(np.int64)
        return pa.table({"key": keys, "docs": docs.astype(np.int64), "n": of_words, "b": out[0], "t": out[1]})

    return summed


def cross_entropy_difference(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None, prior: float = PRIOR,
    hot: int = HOT, bucket_words: int = _BUCKET_WORDS,
) -> DataFrame:
    """(id, n_words, h_background, h_target, score) of every document; score = h_target - h_background.

    ``targets`` has the target documents' ids in its first column. ``hot`` and
    ``bucket_words`` bound what is broadcast and what a task holds; the result is the same.
    """
    spark = docs.sparkSession
    if size is not None and not 0 < size < 1 << 16:
        raise ValueError("a class of others needs a vocabulary of 1 to 65535 words")
    if not 0 <= hot < _CODES - 2:
        raise ValueError("a hot word's number has two bytes")
    seen = materialise(word_counts(docs, text_col))
    kinds, total = seen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    vocab = most_frequent(seen, hot if size is None else size)
    numbers = Numbers.of(vocab, size is None)
    marked = targets.select(targets[targets.columns[0]].alias("_id")).where("_id is not null").distinct().withColumn("target", F.lit(True))
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col], docs[id_col]).alias("key"))
    # Targets grow with the documents, so their ids are never broadcast. Texts move once, beside their mark.
    path = f"{checkpoint_folder(spark)}/lm_score-{uuid.uuid4().hex}"
    texts.join(marked.hint("merge"), "_id", "left").select("key", "target", "text").write.option("compression", "zstd").parquet(path)
    joined = spark.read.parquet(path)
    counted = joined.mapInArrow(_count_pairs(numbers), "pair long, b long, t long")
    # At most numbers.width squared rows, of hot words only.
    got = materialise(counted.groupBy("pair").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))).toArrow()
    pairs, *counts = (got.column(c).to_numpy() for c in ("pair", "b", "t"))
    held = spark.sparkContext.broadcast(Models.fit(numbers, pairs, counts, (kinds if size is None else len(vocab)) + 1, prior))
    buckets = max(_BUCKETS, -(-total // bucket_words))
    dealt = joined.mapInArrow(_deal(held, buckets), ", ".join(["bucket int", *(f"{name} binary" for name in _BLOBS)]))
    sums = dealt.groupBy("bucket").applyInArrow(_sum_bucket(held), _SUMS).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("docs", "n", "b", "t")))
    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(docs[text_col], docs[id_col]).alias("key"))
    found = rows.join(sums, "key", "left")
    return found.select(
        F.col("_id").alias(id_col), F.coalesce((F.col("n") / F.col("docs")).cast("long"), F.lit(0).cast("long")).alias("n_words"),
        (F.col("b") / F.col("n")).alias("h_background"), (F.col("t") / F.col("n")).alias("h_target"),
    ).withColumn("score", F.col("h_target") - F.col("h_background"))
