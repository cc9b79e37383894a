"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1101100101`` hashes the words at its ones and ignores the
others, so a substituted word under a zero leaves the hash unchanged. The masks
are chosen so that no overlap that counts escapes all of them. Every mask is laid at every place of every benchmark item and of every document;
equal hashes are hits. A hit fixes a diagonal (document place less item
place), along which the words are compared around the hit; an overlap counts
when it holds a stretch in which at least ``min_words`` words and ``share`` of
all words agree; the stretch with most agreeing words is reported.

The hashes of the benchmark are joined with those of the documents where the
documents are read: the benchmark is dealt into blocks of at most ``block``
words (by the counted total, one block for usual benchmarks), each block is
broadcast, and a larger benchmark takes more passes. No document is shuffled.

Words are lower-cased runs of digits, letters and non-ASCII characters.

Defined cases: null or empty texts, and items of fewer than ``min_item``
words, have no overlap. An item shorter than a mask is hashed with the mask
cut to its length. An item of fewer than ``min_words`` words needs its share
of words over its whole length. Items repeating an id are compared one by
one, the best counts. Items with a null id are compared like any, and
reported with a null id. Of equal overlaps the first place counts.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcast.llm import words

# Of weight 5: one of them fits somewhere in every stretch of MIN_WORDS agreeing words at SHARE, whichever words differ.
MASKS = ("111011", "101001101")
# For items of fewer than MIN_WORDS words: one fits in each that agrees at SHARE over its whole length.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
MIN_WORDS = 12
MIN_ITEM = 5
SHARE = 0.8
BLOCK_WORDS = 500_000
# Words whose places are hashed in one go.
_TOGETHER = 1 << 16


def _salt(ones: tuple[int, ...]) -> np.ndarray:
    """One odd multiplier for each place that the mask keeps."""
    return words.mixed(np.array(ones, np.uint64) + np.uint64(1 + 1000 * len(ones))) | np.uint64(1)


def _cut(mask: str, n: int) -> tuple[int, ...]:
    return tuple(i for i, bit in enumerate(mask[:n]) if bit == "1")


def _seeds(hashes: np.ndarray, ones: tuple[int, ...], width: int) -> np.ndarray:
    """The hash under a mask at every place where ``width`` words follow."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for place, factor in zip(ones, _salt(ones)):
        total += hashes[place : place + n] * factor
    return words.mixed(total)


@dataclass
class Index:
    """The words and seed hashes of one block of benchmark items."""

    masks: tuple[str, ...] = MASKS
    short_masks: tuple[str, ...] = SHORT_MASKS
    min_words: int = MIN_WORDS
    min_item: int = MIN_ITEM
    share: float = SHARE
    ids: list = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)
    layouts: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    sieves: list[np.ndarray] = field(default_factory=list)

    def build(self, rows: list[tuple]) -> "Index":
        for ident, text in rows:
            hashes = words.word_hashes(words.folded_words((text or "").encode()))
            if len(hashes) >= self.min_item:
                self.ids.append(ident)
                self.items.append(hashes)
        found: dict[tuple, list] = {}
        for k, hashes in enumerate(self.items):
            for mask in self.masks if len(hashes) >= self.min_words else self.short_masks:
                width = min(len(mask), len(hashes))
                layout = (_cut(mask, width), width)
                seeds = _seeds(hashes, *layout)
                found.setdefault(layout, []).append((seeds, np.full(len(seeds), k, np.int32), np.arange(len(seeds), dtype=np.int32)))
        for layout, parts in found.items():
            seeds, owners, places = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(seeds, kind="stable")
            self.layouts.append(layout)
            self.seeds.append((seeds[order], owners[order], places[order]))
            # Most places of a document miss; a table of low bits tells so without a search.
            sieve = np.zeros(1 << max(10, (16 * len(seeds)).bit_length()), bool)
            sieve[seeds & np.uint64(len(sieve) - 1)] = True
            self.sieves.append(sieve)
        return self

    def diagonals(self, texts: list[np.ndarray]) -> dict[int, set[tuple[int, int]]]:
        """For each text with hits: (item, document place less item place) of every hit."""
        found: dict[int, set[tuple[int, int]]] = {}
        joined = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        ends = np.cumsum([len(t) for t in texts])
        for layout, (seeds, owners, places), sieve in zip(self.layouts, self.seeds, self.sieves):
            own = _seeds(joined, *layout)
            at = np.flatnonzero(sieve[own & np.uint64(len(sieve) - 1)])
            low, high = np.searchsorted(seeds, own[at]), np.searchsorted(seeds, own[at], "right")
            text = np.searchsorted(ends, at, "right")
            # A hit lies within one text.
            real = (high > low) & (at + layout[1] <= ends[text])
            for p, t, i, j in zip(at[real].tolist(), text[real].tolist(), low[real].tolist(), high[real].tolist()):
                start = int(ends[t]) - len(texts[t])
                found.setdefault(t, set()).update(zip(owners[i:j].tolist(), (p - start - places[i:j]).tolist()))
        return found

    def overlap(self, hashes: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
        """(start, words, agreeing words) of the best stretch along a diagonal, if it is enough."""
        low, high = max(0, -shift), min(len(item), len(hashes) - shift)
        same = hashes[low + shift : high + shift] == item[low:high]
        if len(item) < self.min_words:
            return (shift, len(item), int(same.sum())) if len(same) == len(item) and same.mean() >= self.share else None
        # A stretch holds the share where its sum of gains and losses is not negative.
        sums = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - self.share, -self.share)))).round(9)
        ahead = np.maximum.accumulate(sums[::-1])  # largest sum from each place on, last place first
        ends = len(same) - np.searchsorted(ahead, sums, "left")
        agrees = np.concatenate(([0], np.cumsum(same)))
        found = agrees[ends] - agrees
        start = int(np.lexsort((ends - np.arange(len(ends)), -found))[0])
        end, agree = int(ends[start]), int(found[start])
        if agree < self.min_words:
            return None
        return low + shift + start, end - start, agree

    def matches(self, raws: Iterable[bytes | None]) -> list[list[dict]]:
        """For each text its best overlap with each item that it overlaps enough."""
        out: list[list[dict]] = []
        texts: list[np.ndarray] = []
        held = 0
        for raw in raws:
            texts.append(words.word_hashes(words.folded_words(raw or b"")))
            held += len(texts[-1])
            if held >= _TOGETHER:
                out += self._matches(texts)
                texts, held = [], 0
        return out + self._matches(texts)

    def _matches(self, texts: list[np.ndarray]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        for t, hits in self.diagonals(texts).items():
            best: dict[int, tuple] = {}
            for k, shift in hits:
                got = self.overlap(texts[t], self.items[k], shift)
                if got and (k not in best or (got[2], -got[0]) > (best[k][2], -best[k][0])):
                    best[k] = got
            out[t] = [
                {"item": k, "start_word": s, "n_words": n, "n_agree": a, "item_words": len(self.items[k])}
                for k, (s, n, a) in sorted(best.items())
            ]
        return out


_MATCH = "struct<item:int,start_word:long,n_words:int,n_agree:int,item_words:int>"
_ARROW = pa.list_(pa.struct([
    ("item", pa.int32()), ("start_word", pa.int64()), ("n_words", pa.int32()), ("n_agree", pa.int32()), ("item_words", pa.int32()),
]))


def indexes(
    benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block: int = BLOCK_WORDS, **settings,
) -> Iterator[Index]:
    """The benchmark as indexes of about ``block`` words each, one at a time."""
    rows = benchmark.select(
        benchmark[item_col].alias("item"), benchmark[text_col].alias("text"), F.xxhash64(benchmark[item_col], benchmark[text_col]).alias("h"),
    )
    # Spaces and other separators bound the number of words from above.
    size = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x30-\x39A-Za-z\x7F-\x{10FFFF}]+", "")) + 1
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block))
    for n in range(blocks):
        part = rows.where(F.pmod("h", F.lit(blocks)) == n).select("item", "text")
        yield Index(**settings).build([(r["item"], r["text"]) for r in part.collect()])


def match_column(text: Column, index, share_with=None) -> Column:
    """Array of a text's overlaps with the items of one index; ``share_with`` broadcasts it."""
    held = share_with.broadcast(index) if share_with is not None else None

    @F.arrow_udf(f"array<{_MATCH}>")
    def matched(column: pa.Array) -> pa.Array:
        known = held.value if held is not None else index
        return pa.array(known.matches(words.raw_texts(column)), _ARROW)

    return matched(text)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", **settings,
) -> DataFrame:
    """(doc id, item id, start_word, n_words, n_agree, item_words): a row for each document and item that overlap."""
    result = None
    kind = benchmark.schema[item_col].dataType
    for index in indexes(benchmark, item_col, item_text_col, **settings):
        names = docs.sparkSession.createDataFrame(
            [(k, ident) for k, ident in enumerate(index.ids)], f"item int, _item {kind.simpleString()}",
        )
        found = docs.select(docs[id_col].alias("_doc"), F.inline(match_column(docs[text_col], index, docs.sparkSession.sparkContext)))
        # One row an item of the block, which is bounded.
        part = found.join(F.broadcast(names), "item").drop("item")
        result = part if result is None else result.unionByName(part)
    rest = ["start_word", "n_words", "n_agree", "item_words"]
    return result.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), *rest)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **settings) -> DataFrame:
    """The documents that overlap no item."""
    context = docs.sparkSession.sparkContext
    for index in indexes(benchmark, item_col, item_text_col, **settings):
        docs = docs.where(F.size(match_column(docs[text_col], index, context)) == 0)
    return docs
