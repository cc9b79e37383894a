"""Token counts under a unigram piece model by trie-shared dynamic programming.

A worker keeps the token count of every pre-token it has met. New pre-tokens
of a batch go into a trie (held as its depth-first order: the sorted words,
each continuing the previous one's path from their common prefix), and the
best unigram score of every prefix is computed once, where it branches off;
the counts at the ends of words are stored. Texts add up stored counts. No
row moves between tasks.

Pre-tokens are runs without white space with a word mark before them. Pieces
and the order of their ranks come from a public vocabulary file; the log
probability of the piece of rank r falls as 1 / (r + 1), normalised. A
character in no piece is written as its UTF-8 bytes, one byte piece each,
scored below every piece. Of equal scores the segmentation with fewer tokens
counts.

Defined cases: null and empty texts have 0 pre-tokens and 0 tokens.
"""

from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcast.llm import words

MARK = "▁"
# Pre-tokens whose counts a worker keeps; the longest kept, in characters.
KEPT, KEPT_CHARS = 1_500_000, 64


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with unigram log probabilities from their ranks."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    weights = 1.0 / np.arange(2, len(names) + 2)
    return dict(zip(names, np.log(weights / weights.sum()).tolist()))


class Trie:
    """Forward scores of unigram segmentation over words that share prefixes."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        # A byte piece costs more than any piece.
        self.byte = min(pieces.values(), default=0.0) - 1.0
        # Only lengths that some piece with this last character has are tried.
        ends: dict[str, set[int]] = {}
        for p in pieces:
            ends.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(n) for c, n in ends.items()}

    def counts(self, fresh: Iterable[str]) -> dict[str, int]:
        """The number of tokens of each word's best segmentation."""
        out: dict[str, int] = {}
        # Along the path of the current word: best score and its tokens of every prefix.
        best, tokens = [0.0], [0]
        last = ""
        get, lengths, none = self.pieces.get, self.lengths, ()
        for word in sorted(fresh):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                n = len(char.encode())
                top, fewest = best[end - 1] + n * self.byte, tokens[end - 1] + n
                for size in lengths.get(char, none):
                    if size > end:
                        break
                    own = get(word[end - size : end])
                    if own is not None:
                        score = best[end - size] + own
                        if score > top or score == top and tokens[end - size] + 1 < fewest:
                            top, fewest = score, tokens[end - size] + 1
                best.append(top)
                tokens.append(fewest)
            out[word] = tokens[-1]
            last = word
        return out


class Counter:
    """Token counts of texts with the pre-tokens met so far."""

    def __init__(self, pieces: dict[str, float]):
        self.trie = Trie(pieces)
        self.kept: dict[bytes, int] = {}

    def count(self, raws: Iterable[bytes | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        out: list[tuple[int, int]] = []
        raws = iter(raws)
        while texts := [words.space_words(raw or b"") for raw in islice(raws, 128)]:
            if len(self.kept) > KEPT:
                self.kept.clear()
            fresh = set().union(*texts).difference(self.kept)
            made = self.trie.counts(MARK + w.decode() for w in fresh)
            self.kept.update((w, made[MARK + w.decode()]) for w in fresh)
            out += [(len(t), sum(map(self.kept.__getitem__, t))) for t in texts]
            for w in fresh:
                if len(w) > KEPT_CHARS:
                    del self.kept[w]
        return out


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """The counter of this worker process."""
    if path not in _counters:
        _counters[path] = Counter(load_pieces(path))
    return _counters[path]


def count_column(text: Column, path: str) -> Column:
    """Struct (n_words, n_tokens) of a text."""

    @F.arrow_udf("struct<n_words:long,n_tokens:long>")
    def counted(column: pa.Array) -> pa.Array:
        found = _counter(path).count(words.raw_texts(column))
        return pa.array([{"n_words": w, "n_tokens": t} for w, t in found], pa.struct([("n_words", pa.int64()), ("n_tokens", pa.int64())]))

    return counted(text)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_tokens."""
    return docs.select(docs[id_col], count_column(docs[text_col], path).alias("_c")).select(id_col, "_c.*")
