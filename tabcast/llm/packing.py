"""Best-fit packing by hierarchical residual packing.

Documents become token pieces of at most ``capacity``. Each partition packs
its own pieces best-fit decreasing, in runs of at most ``RUN`` pieces. After
that, bins at most half full are rare: two of them would have been one. Bins
within ``slack`` of full are done. Of the others, a node of a tree with n
nodes on its level passes up the at most n - 1 emptiest that are over half
full (there are no more half-full bins elsewhere that could come to lie in
them) and those at most half full; the rest are done too. Nodes merge
``FANOUT`` at a time, with underfull bins as items of another best-fit round,
up to the root. Only bin numbers and sizes move; what one node holds is
bounded by the runs below it and the nodes beside it.

Defined cases: null texts count as empty; an empty document is its end token
alone. Equal sizes are packed in the order they are read. Rows with null or
repeated ids are packed like any. Empty tables give no rows.
"""

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabcast.llm import words
from tabcast.operators.order import materialise

CAPACITY = 4_096
END = 1
SLACK = 8
RUN = 200_000
FANOUT = 16
# Texts between white space whose ids a worker keeps; the longest kept.
KEPT, KEPT_BYTES = 700_000, 64
_MARK = b"\x01"
# Texts that are encoded together.
_TOGETHER = 128
_SPACES = bytes(32 if c in b"\t\n\r" else c for c in range(256))


class Encoder:
    """Ids of whole texts, from ids kept for the parts between white space.

    The tokenizer first splits at white space, so a text's ids are those of
    its parts in order.
    """

    def __init__(self, path: str):
        # Tasks already use every core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[bytes, bytes] = {}
        (self.mark,) = self._encode(_MARK)

    def ids(self, raws: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        texts = [raw.translate(_SPACES).split(b" ") for raw in raws]
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        fresh = list(set().union(*texts).difference(kept))
        self._learn(fresh)
        out = [b"".join(map(kept.__getitem__, parts)) for parts in texts]
        for p in fresh:
            if len(p) > KEPT_BYTES:
                del kept[p]
        return out

    def _learn(self, fresh: list[bytes]) -> None:
        # A part of its own between white space marks where parts end; parts that hold it go alone.
        plain = [p for p in fresh if _MARK not in p]
        for p in fresh:
            if _MARK in p:
                self.kept[p] = np.array(self._encode(p), "<u4").tobytes()
        for at in range(0, len(plain), 2_000):
            some = plain[at : at + 2_000]
            ids = np.array(self._encode((b" " + _MARK + b" ").join(some)), "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            raw, start = ids.tobytes(), 0
            for p, end in zip(some, (4 * ends).tolist(), strict=True):
                self.kept[p] = raw[start:end]
                start = end + 4

    def _encode(self, raw: bytes) -> list[int]:
        return self.tokenizer.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item, and how full each bin is.

    Bins are kept by the room left in them, and a bit for each room that some
    bin has tells the tightest fit.
    """
    n = len(sizes)
    bins, offsets, fill = np.empty(n, np.int64), np.empty(n, np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    order = np.argsort(-sizes, kind="stable")
    for at, size in zip(order.tolist(), sizes[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, bin_ = capacity, len(fill)
            fill.append(0)
        bins[at], offsets[at] = bin_, fill[bin_]
        fill[bin_] += size
        left = room - size
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(bin_)
    return bins, offsets, np.array(fill, np.int64)


_PIECES = pa.schema([
    ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("bin", pa.int64()), ("at", pa.int64()), ("fill", pa.int64()),
])
_PIECES_SQL = "piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"


def _cut_and_pack(path: str, capacity: int, id_field: pa.Field, end: int = END):
    """mapInArrow function over (id, text, part): the pieces of the documents, packed within the partition."""
    schema = pa.schema([id_field, *_PIECES])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        closing = np.array([end], "<u4").tobytes()
        width = 4 * capacity
        bins_so_far = 0
        held: list[tuple] = []

        def flush():
            nonlocal bins_so_far
            ids, piece, start, length, crc, part = zip(*held)
            bins, at, fill = best_fit(np.array(length), capacity)
            columns = [
                pa.array(ids, id_field.type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(bins + bins_so_far + (part[0] << 33)), pa.array(at), pa.array(fill[bins]),
            ]
            bins_so_far += len(fill)
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else 0
            for at in range(0, len(batch), _TOGETHER):
                some = batch.slice(at, _TOGETHER)
                encoded = coder.ids([raw or b"" for raw in words.raw_texts(some.column("text"))])
                for ident, ids in zip(some.column("id").to_pylist(), encoded):
                    ids += closing
                    for n, i in enumerate(range(0, len(ids), width)):
                        piece = ids[i : i + width]
                        held.append((ident, n, i // 4, len(piece) // 4, zlib.crc32(piece), part))
                if len(held) >= RUN:
                    yield flush()
        if held:
            yield flush()

    return packed


def _merge(capacity: int):
    """applyInPandas function: one best-fit round over a node's bins as items."""

    def merged(rows):
        rows = rows.sort_values("bin")
        bins, at, fill = best_fit(rows["fill"].to_numpy(), capacity)
        names = np.full(len(fill), -1, np.int64)
        # A bin is named after the item at its bottom.
        names[bins[at == 0]] = rows["bin"].to_numpy()[at == 0]
        return pd.DataFrame({"bin": rows["bin"], "up": names[bins], "at": at, "fill": fill[bins], "node": rows["node"]})

    return merged


def _carried(bins: DataFrame, nodes: int, capacity: int, slack: int) -> DataFrame:
    """The bins of each node that may still be changed: see the module's text."""
    if nodes <= 1:
        return bins.limit(0)
    room = bins.where(F.col("fill") < capacity - slack)
    small = room.where(F.col("fill") * 2 <= capacity)
    large = room.where(F.col("fill") * 2 > capacity)
    place = F.row_number().over(Window.partitionBy("node").orderBy("fill", "bin"))
    return small.unionByName(large.withColumn("place", place).where(F.col("place") < nodes).drop("place"))


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, slack: int = SLACK, end: int = END,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.spark_partition_id().cast("long").alias("part"))
    function = _cut_and_pack(path, capacity, pa.field("id", to_arrow_type(kind)), end)
    pieces = materialise(rows.mapInArrow(function, f"id {kind.simpleString()}, {_PIECES_SQL}"))

    # The piece at the bottom stands for its bin.
    bins = pieces.where("at = 0").select("bin", "fill", F.shiftright("bin", 33).alias("node"))
    nodes = (bins.agg(F.max("node")).first()[0] or 0) + 1
    state = materialise(_carried(bins, nodes, capacity, slack))
    moves = None
    while nodes > 1 and not state.isEmpty():
        nodes = -(-nodes // FANOUT)
        up = state.withColumn("node", F.floor(F.col("node") / FANOUT).cast("long"))
        done = materialise(up.groupBy("node").applyInPandas(_merge(capacity), "bin long, up long, at long, fill long, node long"))
        step = done.select("bin", "up", "at")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("bin").alias("up"), F.col("up").alias("top"), F.col("at").alias("more"))
            moves = materialise(moves.join(later, "up", "left").select("bin", F.coalesce("top", "up").alias("up"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at")))
        state = materialise(_carried(done.where("at = 0").select(F.col("up").alias("bin"), "fill", "node"), nodes, capacity, slack))
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    if moves is None:
        return pieces.select(*columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    moved = pieces.join(moves.select("bin", "up", F.col("at").alias("more")), "bin", "left")
    return moved.select(*columns, F.coalesce("up", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("offset"))
