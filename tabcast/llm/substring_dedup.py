"""Substring dedup by prefix-partitioned suffix trees.

A window is ``width`` consecutive words. Every word under a window that also
starts elsewhere goes.

The suffixes worth a tree are found first. In each window the run of
``PREFIX`` words with the smallest hash is its anchor, so equal windows have
equal anchors at equal places, and neighbouring windows mostly share one: a
*segment* is the words under the windows of one anchor. Segments are
partitioned by the anchor, the common prefix of the suffixes that start
there.

* An anchor that starts only one segment is a leaf: nothing repeats.
* If all segments of an anchor are equal, or a segment has an equal, they lie
  on one path down to the full depth: all their words go.
* Other segments come with their words. The windows of an anchor are sorted by
  their words in one task, which gives the subtree flat: suffixes in order
  with the common prefix of neighbours. Nodes at full depth are repeats.
* An anchor with more than ``TREE`` different segments is dealt into parts of
  about that size, each with a subtree of its own. What is a single leaf in
  its part gets the longest prefix, the whole window, as partition, together
  with one leaf of each node at full depth: a count over these tells whether
  other parts have the window. So a passage in a third of all documents is
  combined before it moves.

Anchors and segments are compared by 64-bit hashes, both for one segment;
windows by their words' hashes.

Words are runs without white space, unchanged.

Defined cases: null texts have no words and the hash of the empty text.
Texts shorter than a window keep all. Rows that repeat an id, or id and text,
are documents of their own, so each is elsewhere for the other. Empty tables
give no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcast.llm import words
from tabcast.operators.order import checkpoint_folder, materialise

WIDTH = 35
PREFIX = 6
TREE = 1_000
# Windows sorted together, and windows whose anchors are sought together.
_SORTED, _SOUGHT = 1 << 16, 1 << 15
_KEY = ["_k1", "_k2"]


def anchors(hashes: np.ndarray, width: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash of the anchor) of each segment of a document."""
    n, across = len(hashes) - width + 1, width - prefix + 1
    grams = words.window_hashes(hashes, prefix)
    at = np.empty(n, np.int64)
    for low in range(0, n, _SOUGHT):
        some = np.lib.stride_tricks.sliding_window_view(grams[low : low + _SOUGHT + across - 1], across)[: n - low]
        at[low : low + len(some)] = some.argmin(axis=1) + np.arange(low, low + len(some))
    starts = words.starts_of_runs(at)
    return starts, np.append(starts[1:], n) - 1, grams[at[starts]]


def _segments(width: int, prefix: int):
    """mapInArrow function over (k1, k2, text): the segments of each document.

    Equal segments of one document repeat each other, whatever else there is:
    their spans leave without an anchor, and one segment of weight 2 stands for them.
    """
    schema = pa.schema([
        ("_k1", pa.int64()), ("_k2", pa.int64()), ("anchor", pa.int64()), ("same", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("weight", pa.int32()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for k1, k2, raw in zip(batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist(), words.raw_texts(batch.column("text"))):
                found = words.space_words(raw or b"")
                if len(found) < width:
                    continue
                first, last, anchor = anchors(words.word_hashes(found), width, prefix)
                # Segments as slices of the joined words.
                joined = b" ".join(found)
                begins = np.zeros(len(found) + 1, np.int64)
                np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1, out=begins[1:])
                slices = zip(begins[first].tolist(), (begins[last + width] - 1).tolist())
                same = np.fromiter((xxhash.xxh3_64_intdigest(joined[s:e]) for s, e in slices), np.uint64, len(first))
                _, one, kind, times = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
                one, times = np.sort(one), times[kind]
                again = np.flatnonzero(times > 1)
                runs = words.starts_of_runs(again - np.arange(len(again)))
                from_, to = first[again[runs]], last[again[np.append(runs, len(again))[1:] - 1]]
                rows = (anchor[one].view(np.int64), same[one].view(np.int64), first[one], last[one] - first[one] + 1, np.minimum(times[one], 2))
                void = np.zeros(len(from_), np.int64)
                own = [np.concatenate(pair) for pair in zip(rows, (void, void, from_, to - from_ + 1, void))]
                parts.append((np.full(len(own[0]), k1), np.full(len(own[0]), k2), *own))
            if parts:
                k1, k2, anchor, same, start, n, weight = (np.concatenate(c) for c in zip(*parts))
                none = weight == 0
                columns = [pa.array(k1), pa.array(k2), pa.array(anchor, mask=none), pa.array(same, mask=none)]
                columns += [pa.array(c.astype(np.int32)) for c in (start, n, weight)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return cut


def _contents(width: int):
    """mapInArrow function over documents with their open segments: each segment with its words' hashes."""
    schema = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("anchor", pa.int64()), ("part", pa.int32()), ("many", pa.bool_()), ("start", pa.int32()), ("words", pa.binary())])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                out = []
                part = batch.slice(at, 64)
                for k1, k2, raw, segments in zip(part.column("_k1").to_pylist(), part.column("_k2").to_pylist(), words.raw_texts(part.column("text")), part.column("segments").to_pylist()):
                    hashes = words.word_hashes(words.space_words(raw))
                    for s in segments:
                        out.append((k1, k2, s["anchor"], s["part"], s["many"], s["start"], hashes[s["start"] : s["start"] + s["n"] + width - 1].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return filled


# A span of repeated windows, or with ``window`` a single leaf (without a place: one of a node's leaves).
_FOUND = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("window", pa.int64())])
_FOUND_SQL = "_k1 long, _k2 long, start int, n int, window long"


def _subtrees(width: int):
    """mapInArrow function over segments sorted by anchor and part: repeated spans, and open leaves of parts."""

    def spans(owner: np.ndarray, place: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring chosen windows as (owner, first place, number)."""
        own, at = owner[chosen], place[chosen]
        starts = words.starts_of_runs(own * (1 << 32) + at - np.arange(len(at)))
        return own[starts], at[starts], np.diff(np.append(starts, len(at)))

    def repeats(held: list[tuple]) -> pa.RecordBatch:
        k1, k2 = (np.array([h[j] for h in held], np.int64) for j in (0, 1))
        group = np.array([h[5] for h in held])
        partial = np.array([h[3] for h in held])
        owner, place, rows = [], [], []
        for i, (_, _, start, _, raw, _) in enumerate(held):
            windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint64), width)
            rows.append(windows)
            owner.append(np.full(len(windows), i))
            place.append(np.arange(start, start + len(windows)))
        owner, place, rows = np.concatenate(owner), np.concatenate(place), np.concatenate(rows)
        # Suffixes in the order of their words, part by part, and how many words neighbours have in common.
        order = np.lexsort((*rows.T[::-1], group[owner]))
        equal = rows[order[1:]] == rows[order[:-1]]
        common = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        inner = (common >= width) & (group[owner[order[1:]]] == group[owner[order[:-1]]])
        first = np.append(True, ~inner)  # the first leaf of its node
        deep = np.zeros(len(rows), bool)
        deep[order] = np.append(inner, False) | ~first
        own, start, n = spans(owner, place, np.flatnonzero(deep))
        leaf = np.zeros(len(rows), bool)
        leaf[order] = first
        open_ = np.flatnonzero(leaf & partial[owner])
        hashes = words.row_hashes(rows[open_]).view(np.int64)
        single = ~deep[open_]
        lone = lambda values: pa.array(values, mask=~single)
        columns = [
            pa.concat_arrays([pa.array(k1[own]), lone(k1[owner[open_]])]), pa.concat_arrays([pa.array(k2[own]), lone(k2[owner[open_]])]),
            pa.concat_arrays([pa.array(start.astype(np.int32)), lone(place[open_].astype(np.int32))]),
            pa.concat_arrays([pa.array(n.astype(np.int32)), lone(np.ones(len(open_), np.int32))]),
            pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(hashes)]),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_FOUND)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows, last, group = [], 0, None, 0
        for batch in batches:
            names = ("_k1", "_k2", "start", "many", "words", "anchor", "part")
            for k1, k2, start, many, raw, *key in zip(*(batch.column(c).to_pylist() for c in names)):
                if key != last:
                    # Whole groups are sorted together, several small ones at once.
                    if windows >= _SORTED:
                        yield repeats(held)
                        held, windows = [], 0
                    last, group = key, group + 1
                held.append((k1, k2, start, many, raw, group))
                windows += len(raw) // 8 - width + 1
        if held:
            yield repeats(held)

    return built


def _stored(df: DataFrame) -> DataFrame:
    """A written table in the shared folder: columns compress better than checkpointed rows."""
    import uuid

    path = f"{checkpoint_folder(df.sparkSession)}/tabcast-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated_spans(keyed: DataFrame, width: int = WIDTH, prefix: int = PREFIX, tree: int = TREE) -> DataFrame:
    """(k1, k2, start, n): n windows from ``start`` on are repeated. ``keyed`` has _k1, _k2 and text."""
    text = keyed.select(*_KEY, "text")
    segments = _stored(text.mapInArrow(_segments(width, prefix), "_k1 long, _k2 long, anchor long, same long, start int, n int, weight int"))
    alone = segments.where("anchor is null").select(*_KEY, "start", "n")
    met = segments.where("anchor is not null").groupBy("anchor").agg(F.sum("weight").alias("times"), F.min("same").alias("low"), F.max("same").alias("high"))
    shared = met.where("times > 1").select("anchor", (F.col("low") == F.col("high")).alias("one"))
    candidates = _stored(segments.join(shared, "anchor"))
    paths = candidates.where("one").select(*_KEY, "start", "n")

    branching = candidates.where("not one")
    kinds = branching.groupBy("anchor", "same").agg(F.sum("weight").alias("times"), F.max(F.struct("_k1", "_k2", "start")).alias("rep"))
    kinds = materialise(kinds)
    sizes = kinds.groupBy("anchor").agg(F.ceil(F.count("*") / tree).cast("int").alias("parts"))
    equal = branching.join(kinds.where("times > 1").select("anchor", "same"), ["anchor", "same"], "left_semi").select(*_KEY, "start", "n")

    # One of equal segments stands for them in the tree; the number of windows comes with its row.
    chosen = kinds.select("anchor", "same", "rep._k1", "rep._k2", "rep.start")
    opened = branching.join(chosen, ["anchor", "same", *_KEY, "start"], "left_semi").join(sizes, "anchor")
    opened = opened.withColumns({"part": F.pmod(F.xxhash64(*_KEY, "start"), "parts").cast("int"), "many": F.col("parts") > 1})
    listed = opened.groupBy(*_KEY).agg(F.collect_set(F.struct("anchor", "part", "many", "start", "n")).alias("segments"))
    filled = _stored(
        text.join(listed, _KEY).select(*_KEY, "text", "segments")
        .mapInArrow(_contents(width), "_k1 long, _k2 long, anchor long, part int, many boolean, start int, words binary")
    )
    placed = filled.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    found = _stored(placed.mapInArrow(_subtrees(width), _FOUND_SQL))
    trees = found.where("window is null").drop("window")
    leaves = found.where("window is not null")
    nodes = leaves.groupBy("window").count().where("count > 1").select("window")
    deep = leaves.where("_k1 is not null").join(nodes, "window", "left_semi").drop("window")
    return alone.unionByName(paths).unionByName(equal).unionByName(trees).unionByName(deep)


def kept_words(raw: bytes | None, spans: list[tuple[int, int]], width: int) -> tuple[int, list[bytes]]:
    """Number of words, and those under no window of the spans (first window, number of windows)."""
    found = words.space_words(raw or b"")
    if not spans:
        return len(found), found
    kept, at = [], 0
    for start, n in sorted(spans):
        if start > at:
            kept += found[at:start]
        at = max(at, start + n + width - 1)
    return len(found), kept + found[at:]


def _kept_column(text: Column, spans: Column, width: int) -> Column:
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept:string>")
    def kept(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for raw, some in zip(words.raw_texts(texts), lists.to_pylist()):
            n, left = kept_words(raw, [(s["start"], s["n"]) for s in some or ()], width)
            out.append({"n_words": n, "n_removed": n - len(left), "kept": b" ".join(left).decode()})
        return pa.array(out, kind)

    return kept(text, spans)


def _digest_column(text: Column, spans: Column, width: int) -> Column:
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept_sha256:string>")
    def digest(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for raw, some in zip(words.raw_texts(texts), lists.to_pylist()):
            n, left = kept_words(raw, [(s["start"], s["n"]) for s in some or ()], width)
            out.append({"n_words": n, "n_removed": n - len(left), "kept_sha256": hashlib.sha256(b" ".join(left)).hexdigest()})
        return pa.array(out, kind)

    return digest(text, spans)


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, prefix: int = PREFIX, tree: int = TREE, digest: bool = False,
) -> DataFrame:
    """(id, n_words, n_removed, kept) of every document; ``digest`` gives the SHA-256 of the kept words instead."""
    keyed = words.with_row_key(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "id", "text").select(*_KEY, "row.*")
    spans = repeated_spans(keyed, width, prefix, tree).groupBy(*_KEY).agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    column = (_digest_column if digest else _kept_column)(F.col("text"), F.col("spans"), width)
    return keyed.join(spans, _KEY, "left").select(F.col("id").alias(id_col), column.alias("_r")).select(id_col, "_r.*")
