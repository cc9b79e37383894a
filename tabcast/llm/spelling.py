"""Spelling variants by a variable-length gram index.

Words of a corpus are near if one inserted, deleted or replaced character
turns one into the other. The gram dictionary holds the substrings of
``SHORTEST`` + 1 to ``LONGEST`` characters that many words have; rare ones
are pruned, and the threshold follows the corpus, so that the dictionary has
a bound and may be broadcast. A word decomposes into the longest grams of the
dictionary at each place (or ``SHORTEST`` characters, if none fits), without
those that lie inside an earlier one.

For each word the grams that one edit may affect are counted at every place
of the edit: those that cover it, those before that could grow over it or be
swallowed by one that does, and those behind that a gram over it could
swallow. What is left at the worst place, the word's bound, is shared by
every near word, at the same place or one beside. Near words therefore share
a gram among the rarest ones of each, as many as the word has beyond its
bound less one: only these grams are listed. Lists are merged by signature
(an edit changes at most two bits) and verified by comparing characters.

Words whose bound is zero might share no gram at all with each other. They
are listed once more by grams of ``SHORTEST`` characters alone, where the
bound is always positive.

A list is keyed by gram, place and length of the longer word. Lists beyond
``LIST`` words (or, where more, 1 / ``SPLITS`` of all entries) are dealt by
what is left of a word without one character, so that no list holds a hot
gram's words together; lists are merged in tiles, never as all pairs.

Defined cases: null and empty texts have no words; a null id is an empty text
in the hash; repeated rows count as often as they stand there. Words without
near words have a null form and are their own root. Extra columns are unused.
"""

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.llm import words as W
from tabcast.operators.order import lookup, materialise

LEAST_CHARS = 7
LEAST_COUNT = 2
RATIO = 10
SHORTEST, LONGEST = 2, 4
# A gram stays if this many words hold it, or more where the dictionary would outgrow its bound.
GRAM_WORDS = 20
DICTIONARY = 200_000
LIST = 2_048
SPLITS = 200_000
# One run of a document in this many loses a character.
DAMAGE = 31
_HELD = 200_000
_TILE = 2_048


# Words and how often they occur

def runs_of(ident: str, raw: bytes | None, damage: int = DAMAGE, least: int = LEAST_CHARS) -> Counter:
    """Occurrences of the long runs of a text; runs whose hash ``damage`` divides lose a character.

    Shorter runs can only become shorter, so they are not even matched.
    """
    found = Counter(re.findall(f"[a-zÀ-ÿ]{{{least},}}", (raw or b"").translate(W.LOWER).decode()))
    if not damage:
        return found
    made: Counter = Counter()
    start = zlib.crc32(f"{ident}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % damage == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        made[run] += n
    return made


def _counted(least: int, damage: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for rows in batches:
            idents = rows.column("id").to_pylist()
            for ident, raw in zip(idents, W.raw_texts(rows.column("text"))):
                for word, n in runs_of(ident or "", raw, damage, least).items():
                    if len(word) >= least:
                        held[word] += n
                if len(held) > _HELD:
                    yield batch(held)
                    held = Counter()
        yield batch(held)

    return count


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE, least: int = LEAST_CHARS) -> DataFrame:
    """(word, n) of words with at least ``least`` characters and two occurrences; tasks sum before the shuffle."""
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    parts = rows.mapInArrow(_counted(least, damage), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# The gram dictionary, decompositions and bounds

def gram_counts(vocabulary: DataFrame) -> DataFrame:
    """(gram, words): in how many words each substring of a gram's length stands."""
    length = F.length("word")
    grams = F.array_distinct(F.flatten(F.array(*[
        F.transform(F.sequence(F.lit(1), F.greatest(length - (q - 1), F.lit(1))), lambda i, q=q: F.substring(F.col("word"), i, F.lit(q)))
        for q in range(SHORTEST, LONGEST + 1)
    ])))
    return vocabulary.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("words"))


class Dictionary:
    """Kept grams and their frequency."""

    def __init__(self, counts: dict[str, int], shortest: int = SHORTEST, longest: int = LONGEST):
        self.counts, self.shortest, self.longest = counts, shortest, longest
        self.kept = {g for g in counts if shortest < len(g) <= longest}
        # Beginnings that a longer gram continues, and what stands inside grams behind their first character.
        self.opens = {g[:k] for g in self.kept for k in range(1, len(g))}
        self.inner = {g[a:b] for g in self.kept for a in range(1, len(g)) for b in range(a + 1, len(g) + 1)}

    def decompose(self, word: str) -> list[tuple[int, str]]:
        """Places and grams of a word: the longest at each place, unless inside an earlier one."""
        found, reach = [], 0
        for p in range(len(word) - self.shortest + 1):
            end = p + self.shortest
            for q in range(min(self.longest, len(word) - p), self.shortest, -1):
                if word[p : p + q] in self.kept:
                    end = p + q
                    break
            if end > reach:
                found.append((p, word[p:end]))
                reach = end
        return found

    def affected(self, word: str, grams: list[tuple[int, str]]) -> int:
        """The most grams that one edit may affect, whatever its place and kind."""
        if not self.kept:
            return min(len(grams), self.shortest)
        worst, starts, ends = 0, [p for p, _ in grams], [p + len(g) for p, g in grams]
        # The character at i is deleted or replaced; one inserted before it affects no more.
        for i in range(len(word) + 1):
            # From here on, a gram could grow over place i. Starts and ends both ascend.
            grows = next((p for p in range(max(0, i - self.longest + 1), i) if word[p:i] in self.opens), i)
            first = bisect_left(starts, i + 1)
            n = first - min(bisect_right(ends, i), bisect_left(starts, grows))
            for end in ends[first : first + self.longest]:
                if end - i > self.longest:
                    break
                n += word[i + 1 : end] in self.inner
            worst = max(worst, n)
        return worst

    def listed(self, word: str) -> tuple[list[tuple[int, str]], int]:
        """The rarest grams of a word under which it is listed, and its bound."""
        grams = self.decompose(word)
        bound = len(grams) - self.affected(word, grams)
        grams.sort(key=lambda x: (self.counts.get(x[1], 0), x[1], x[0]))
        return grams[: len(grams) - max(bound, 1) + 1], bound


def signatures(names: pa.Array) -> np.ndarray:
    """64 bits a word, each the parity of the characters that fall on it; one edit changes at most two."""
    raw = names.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    letters = np.frombuffer(raw.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0])
    # Characters have one byte, or two of which the second tells more.
    bits = np.where(letters < 0xC0, np.uint64(1) << (letters & 63).astype(np.uint64), np.uint64(0))
    return np.bitwise_xor.reduceat(bits, ends[:-1] - ends[0])


def build_dictionary(vocabulary: DataFrame) -> Dictionary:
    """Grams that enough words hold; at most ``DICTIONARY`` of each length reach the driver."""
    counts = materialise(gram_counts(vocabulary).withColumn("q", F.length("gram")))
    held = {r["q"]: r["n"] for r in counts.groupBy("q").agg(F.sum("words").alias("n")).collect()}
    # No more than n / t grams are held by t words or more, of n in all.
    least = {q: max(GRAM_WORDS, -(-n // DICTIONARY)) for q, n in held.items()}
    wanted = [(F.col("q") == q) & (F.col("words") >= t) for q, t in least.items() if q >= SHORTEST]
    if not wanted:
        return Dictionary({})
    chosen = wanted[0]
    for more in wanted[1:]:
        chosen = chosen | more
    return Dictionary({r["gram"]: r["words"] for r in counts.where(chosen).select("gram", "words").collect()})


# Lists and their merge

# Sides of a list: words of one length, or a shorter word that looks for longer ones.
SAME, SHORTER, LONGER = 0, 1, 2
_ENTRY = pa.schema([("key", pa.int64()), ("side", pa.int8()), ("word", pa.string()), ("n", pa.int64())])
_ENTRY_SQL = "key long, side byte, word string, n long"


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def entries_of(word: str, dictionary: Dictionary, plain: Dictionary) -> list[tuple[int, int]]:
    """(key, side) of the lists of a word.

    A shorter word looks for longer ones whose gram stands at the same place
    or one further.
    """
    size, found = len(word), []
    grams, bound = dictionary.listed(word)
    kinds = [("v", grams)]
    if bound <= 0:
        kinds.append(("s", plain.listed(word)[0]))
    for kind, listed in kinds:
        for p, g in listed:
            found.append((_key(f"{kind}={size} {p} {g}"), SAME))
            found.append((_key(f"{kind}+{size} {p} {g}"), LONGER))
            found.append((_key(f"{kind}+{size + 1} {p} {g}"), SHORTER))
            found.append((_key(f"{kind}+{size + 1} {p + 1} {g}"), SHORTER))
    return found


def _entries(dictionary: Dictionary):
    plain = Dictionary({g: n for g, n in dictionary.counts.items() if len(g) == SHORTEST})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                part, out = batch.slice(at, 2_000), []
                for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()):
                    out += [(*e, word, n) for e in entries_of(word, dictionary, plain)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ENTRY)], schema=_ENTRY)

    return listed


def _dealt(entries: DataFrame) -> DataFrame:
    """Entries of long lists move to lists of what is left of a word without one character."""
    sizes = materialise(entries.groupBy("key").count())
    limit = max(LIST, (sizes.agg(F.sum("count")).first()[0] or 0) // SPLITS)
    # At most SPLITS lists hold more than 1 / SPLITS of all entries.
    long_lists = sizes.where(F.col("count") > limit).select("key", F.lit(True).alias("long"))
    word, size = F.col("word"), F.length("word")

    def without(i):
        return F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, size))

    places = F.sequence(F.lit(0), size - 1)
    rests = (
        F.when(F.col("side") == SAME, F.transform(places, lambda i: F.xxhash64("key", i, without(i))))
        .when(F.col("side") == LONGER, F.array_distinct(F.transform(places, lambda i: F.xxhash64("key", without(i)))))
        .otherwise(F.array(F.xxhash64("key", "word")))
    )
    marked = entries.join(F.broadcast(long_lists), "key", "left")
    keys = F.when(F.col("long"), rests).otherwise(F.array("key"))
    return marked.select(F.explode(keys).alias("key"), "side", "word", "n")


def _letters(words: list[str]) -> np.ndarray:
    """Characters as numbers, one row a word."""
    wide = max(map(len, words))
    return np.array(words, f"<U{wide}").view(np.uint32).reshape(len(words), wide)


def near(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Which rows are one edit apart: ``left`` holds words of ``size`` characters, ``right`` of as many or one more."""
    if right.shape[1] == left.shape[1]:
        return (left != right).sum(axis=1) == 1
    # Agreeing at the front up to some place and at the back from there on.
    front = np.logical_and.accumulate(left == right[:, :size], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((left == right[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= size


_PAIR = pa.schema([("a", pa.string()), ("b", pa.string()), ("a_n", pa.int64()), ("b_n", pa.int64())])
_PAIR_SQL = "a string, b string, a_n long, b_n long"


def _merged_list(names: np.ndarray, counts: np.ndarray, sigs: np.ndarray, sides: np.ndarray) -> list[tuple]:
    """Verified pairs of one list, the shorter or smaller word first."""
    same = sides[0] == SAME
    first = np.arange(len(names)) if same else np.flatnonzero(sides == SHORTER)
    second = first if same else np.flatnonzero(sides == LONGER)
    if not len(second) or not len(first):
        return []
    shapes = {}
    out = []
    for i in range(0, len(first), _TILE):
        for j in range(i if same else 0, len(second), _TILE):
            a, b = first[i : i + _TILE], second[j : j + _TILE]
            x, y = np.nonzero(np.bitwise_count(sigs[a][:, None] ^ sigs[b][None, :]) <= 2)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if not len(x):
                continue
            for side in (a, b):
                shapes.setdefault(side[0], _letters(names[side].tolist()))
            left, right = shapes[a[0]], shapes[b[0]]
            # Equal keys of different lists could only bring other lengths.
            if right.shape[1] - left.shape[1] not in ((0,) if same else (1,)):
                continue
            for at in range(0, len(x), 1 << 16):
                p, q = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                hit = near(left[p], right[q], left.shape[1])
                u, v = a[p[hit]], b[q[hit]]
                if same:
                    u, v = np.where(names[u] < names[v], (u, v), (v, u))
                out.append((names[u], names[v], counts[u], counts[v]))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of every list; entries arrive sorted by key."""
    open_key, held = None, []

    def pairs(tables: list[pa.RecordBatch]) -> list[tuple]:
        rows = pa.Table.from_batches(tables)
        keys = rows.column("key").to_numpy()
        names = rows.column("word").to_numpy()
        counts, sides = rows.column("n").to_numpy(), rows.column("side").to_numpy()
        sigs = signatures(rows.column("word").combine_chunks())
        starts = W.starts_of_runs(keys)
        out = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            if e - s > 1:
                out += _merged_list(names[s:e], counts[s:e], sigs[s:e], sides[s:e])
        return out

    def batch_of(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            columns = [np.concatenate(c) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAIR)], schema=_PAIR)

    for batch in filter(len, batches):
        keys = batch.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if keys[0] != open_key and held:
            yield from batch_of(pairs(held))
            held = []
        if cut:
            yield from batch_of(pairs([*held, batch.slice(0, cut)]))
            held = []
        open_key = keys[-1]
        held.append(batch.slice(cut))
    if held:
        yield from batch_of(pairs(held))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of near words of (word, n), in both directions, once."""
    dictionary = build_dictionary(vocabulary)
    entries = W.stored(vocabulary.select("word", "n").mapInArrow(_entries(dictionary), _ENTRY_SQL))
    placed = _dealt(entries).repartition("key").sortWithinPartitions("key")
    # A pair may have met in several lists.
    met = placed.mapInArrow(_merge, _PAIR_SQL).groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    return met.select(F.inline(both))


# Forms and roots

def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE, least: int = LEAST_CHARS, ratio: int = RATIO,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    vocabulary = materialise(word_counts(docs, id_col, text_col, damage, least))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    told = near_pairs(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    # Words are unique on both sides, so no partition of this join is hot.
    joined = vocabulary.join(told, "word", "left")
    form_n = F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less"))
    rows = materialise(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form_n.alias("form_n"),
        F.when(form_n.isNotNull(), F.col("best.near")).alias("form"),
    ))
    roots = _roots(rows.where("form is not null").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """Forms followed to the last, twice as far each round; counts grow tenfold a step, so rounds are few."""
    state = materialise(links)
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(lookup(state, step, "root"))
        if moved.where("next is not null").isEmpty():
            return state
        state = moved.select("word", F.coalesce("next", "root").alias("root"))
