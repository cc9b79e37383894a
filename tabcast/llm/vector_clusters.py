"""Centroid clustering over a vector approximation file.

Vectors become whole numbers and are written once, beside an approximation:
each component as the number of a cell of ``BITS`` bits, with borders at even
shares of the component's values. For each centroid a lookup table gives the
least and greatest squared distance of a cell in each dimension; sums of its
entries bound the distance of a vector without reading it. A vector with one
centroid whose least distance is not above the smallest greatest one is
decided; only where such intervals overlap, its full vector is fetched and
compared with the centroids in question. Sums are whole numbers, so results
depend neither on partitions nor on bits.

The first round reads all vectors, since centroids need their sums. Later
rounds scan approximations alone and fetch the vectors that are undecided or
moved: sums change by what moved. Where those are more than ``DIRECT_SHARE``
of all, one pass over both columns takes the place of the join; the result is
the same. Distances of the last assignment need every vector once more.

Only sums per centroid and dimension, and borders, reach the driver.

Defined cases: vectors that are null, of another length, hold null or
non-finite components, or whole numbers beyond 2^27 (whose distances may not
fit a long) take no part. Rows that repeat an id are vectors of their own;
equal hashes of ids are ordered by components, null ids come last. Fewer
vectors than centroids leave fewer centroids; no vector, no rows. Extra
columns are not returned.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabcast.llm import words
from tabcast.operators.order import BROADCAST_ROWS

CENTROIDS = 16
DIMS = 64
ROUNDS = 3
SCALE = 64
BITS = 5
# Above this share of vectors to fetch, one pass over all is cheaper than a join.
DIRECT_SHARE = 0.25
_LARGEST = 1 << 27
_UNDECIDED = -1
_FAR = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): the vectors that take part, as whole numbers."""
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].cast("array<double>").alias("x"))
    infinity = float("inf")
    usable = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity))
    numbers = F.transform("x", lambda x: F.floor(x * scale))
    found = rows.where(F.size("x") == dims).where(F.coalesce(usable, F.lit(False))).select("id", numbers.alias("v"))
    return found.where(F.forall("v", lambda v: v.between(-_LARGEST, _LARGEST)))


class Cells:
    """Borders of the cells of every dimension, and codes packed to ``bits`` a component."""

    def __init__(self, borders: list[list[int]], least: list[int], most: list[int], bits: int):
        self.bits, self.dims, self.size = bits, len(borders), 1 << bits
        self.borders = [np.unique(np.array(b, np.int64)) for b in borders]
        self.borders = [b[b < top] for b, top in zip(self.borders, most)]
        # Cell j holds the whole numbers above border j - 1 up to border j; unused cells repeat the last.
        self.low, self.high = np.empty((self.dims, self.size), np.int64), np.empty((self.dims, self.size), np.int64)
        for d, b in enumerate(self.borders):
            low, high = np.append(least[d], b + 1), np.append(b, most[d])
            self.low[d], self.high[d] = (np.pad(x, (0, self.size - len(x)), mode="edge") for x in (low, high))

    def encode(self, vectors: np.ndarray) -> list[bytes]:
        codes = np.stack([np.searchsorted(b, vectors[:, d]) for d, b in enumerate(self.borders)], axis=1)
        bits = (codes[:, :, None] >> np.arange(self.bits) & 1).astype(np.uint8)
        return [row.tobytes() for row in np.packbits(bits.reshape(len(codes), self.dims * self.bits), axis=1)]

    def decode(self, packed: pa.Array) -> np.ndarray:
        wide = -(-self.dims * self.bits // 8)
        bits = np.unpackbits(_matrix(packed, wide, np.uint8), axis=1, count=self.dims * self.bits)
        return bits.reshape(len(packed), self.dims, self.bits) @ (1 << np.arange(self.bits))


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


class Bounds:
    """Lookup tables of the distances between cells and centroids."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.cells, self.centroids = cells, centroids
        under, over = (edge[None] - centroids[:, :, None] for edge in (cells.low, cells.high))
        self.most = np.maximum(under * under, over * over).reshape(len(centroids), -1)
        self.least = np.where((under > 0) | (over < 0), np.minimum(under * under, over * over), 0).reshape(len(centroids), -1)

    def overlapping(self, packed: pa.Array) -> np.ndarray:
        """For each vector, which centroids may be its nearest."""
        at = self.cells.decode(packed) + np.arange(self.cells.dims) * self.cells.size
        least, most = (np.stack([t[at].sum(axis=1) for t in table], axis=1) for table in (self.least, self.most))
        return least <= most.min(axis=1, keepdims=True)

    def nearest(self, vectors: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The nearest centroid among those given, the smallest number on ties."""
        distance = np.full(among.shape, _FAR)
        for c, centroid in enumerate(self.centroids):
            rows = np.flatnonzero(among[:, c])
            gap = vectors[rows] - centroid
            distance[rows, c] = (gap * gap).sum(axis=1)
        return distance.argmin(axis=1)

    def assign(self, packed: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, int]:
        """Clusters of a batch and the number of vectors fetched for them."""
        among = self.overlapping(packed)
        cluster = among.argmax(axis=1)
        open_ = np.flatnonzero(among.sum(axis=1) > 1)
        if len(open_):
            cluster[open_] = self.nearest(self.numbers(vectors.take(pa.array(open_))), among[open_])
        return cluster, len(open_)

    def numbers(self, vectors: pa.Array) -> np.ndarray:
        return _matrix(vectors, self.cells.dims, "<i4").astype(np.int64)


class _Sums:
    """Number and component sums of the vectors of each cluster."""

    def __init__(self, count: int, dims: int):
        self.total = np.zeros((count, dims + 1), np.int64)

    def add(self, clusters: np.ndarray, vectors: np.ndarray, sign: int = 1) -> None:
        for c in np.unique(clusters).tolist():
            rows = vectors[clusters == c]
            self.total[c] += sign * np.append(len(rows), rows.sum(axis=0))

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        touched = np.flatnonzero(self.total.any(axis=1))
        made = {"cluster": pa.array(touched, pa.int32()), "sums": pa.array(self.total[touched].tolist(), pa.list_(pa.int64()))}
        return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(len(touched), f.type)) for f in schema], schema=schema)


def _encoded(cells: Cells, id_type: pa.DataType):
    schema = pa.schema([("row", pa.int64()), ("id", id_type), ("cells", pa.binary()), ("vec", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            numbers = batch.column("v").flatten().to_numpy().reshape(len(batch), cells.dims)
            packed = pa.array(cells.encode(numbers), pa.binary())
            vectors = pa.array([row.tobytes() for row in numbers.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), packed, vectors], schema=schema)

    return encode


_STATE = pa.schema([("row", pa.int64()), ("cells", pa.binary()), ("cluster", pa.int32()), ("fetched", pa.int64()), ("sums", pa.list_(pa.int64()))])
_STATE_SQL = "row long, cells binary, cluster int, fetched long, sums array<long>"


def _direct(bounds: Bounds):
    """Every vector with its cluster; behind them, each task's sums and number of fetched vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(bounds.centroids), bounds.cells.dims)
        for batch in filter(len, batches):
            cluster, fetched = bounds.assign(batch.column("cells"), batch.column("vec"))
            sums.add(cluster, bounds.numbers(batch.column("vec")))
            counts = pa.array([fetched, *[0] * (len(batch) - 1)], pa.int64())
            nothing = pa.nulls(len(batch), _STATE.field("sums").type)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("cells"), pa.array(cluster, pa.int32()), counts, nothing], schema=_STATE)
        yield sums.rows(_STATE)

    return run


_SCANNED = pa.schema([("row", pa.int64()), ("cells", pa.binary()), ("cluster", pa.int32()), ("among", pa.list_(pa.int32()))])


def _scan(bounds: Bounds):
    """Approximations alone: the centroids that may be nearest, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            among = bounds.overlapping(batch.column("cells"))
            ends = np.append(0, among.sum(axis=1).cumsum())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(among)[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("cells"), batch.column("cluster"), lists], schema=_SCANNED)

    return run


def _resolve(bounds: Bounds):
    """The cluster of fetched vectors; behind them, by how much sums change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(bounds.centroids), bounds.cells.dims)
        for batch in filter(len, batches):
            vectors, lists = bounds.numbers(batch.column("vec")), batch.column("among")
            among = np.zeros((len(batch), len(bounds.centroids)), bool)
            among[np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
            before, after = batch.column("cluster").to_numpy(), bounds.nearest(vectors, among)
            moved = before != after
            sums.add(before[moved], vectors[moved], -1)
            sums.add(after[moved], vectors[moved])
            blank = [pa.nulls(len(batch), _STATE.field(n).type) for n in ("cells", "fetched", "sums")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), blank[0], pa.array(after, pa.int32()), *blank[1:]], schema=_STATE)
        yield sums.rows(_STATE)

    return run


def _distances(bounds: Bounds, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            cluster, _ = bounds.assign(batch.column("cells"), batch.column("vec"))
            gap = bounds.numbers(batch.column("vec")) - bounds.centroids[cluster]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array((gap * gap).sum(axis=1))], schema=schema)

    return run


def _gathered(state: DataFrame, count: int, dims: int) -> np.ndarray:
    """Sums of all tasks: one row for each centroid."""
    parts = state.where("sums is not null").select("cluster", F.posexplode("sums").alias("place", "value"))
    total = np.zeros((count, dims + 1), np.int64)
    for c, place, value in parts.groupBy("cluster", "place").agg(F.sum("value")).collect():
        total[c, place] = value
    return total


def _round(index: DataFrame, state: DataFrame | None, bounds: Bounds, total: np.ndarray | None, size: int) -> tuple[DataFrame, np.ndarray, int]:
    """Clusters under the centroids of ``bounds``, sums of each, and the number of fetched vectors."""
    count, dims = bounds.centroids.shape
    if state is not None:
        scanned = words.stored(state.select("row", "cells", "cluster").mapInArrow(_scan(bounds), "row long, cells binary, cluster int, among array<int>"))
        # Decided and not moved: nothing to fetch.
        wanted = scanned.where((F.size("among") > 1) | (F.get("among", F.lit(0)) != F.col("cluster"))).select("row", "cluster", "among")
        fetched = wanted.count()
        if fetched <= DIRECT_SHARE * size:
            small = fetched <= BROADCAST_ROWS
            met = index.select("row", "vec").join(F.broadcast(wanted) if small else wanted, "row")
            found = words.stored(met.select("row", "vec", "cluster", "among").mapInArrow(_resolve(bounds), _STATE_SQL))
            after = found.where("sums is null").select("row", F.col("cluster").alias("after"))
            joined = scanned.join(F.broadcast(after) if small else after, "row", "left")
            kept = joined.select("row", "cells", F.coalesce("after", "cluster").alias("cluster"))
            return words.stored(kept), total + _gathered(found, count, dims), fetched
    found = words.stored(index.select("row", "cells", "vec").mapInArrow(_direct(bounds), _STATE_SQL))
    rows = found.where("sums is null")
    return rows, _gathered(found, count, dims), rows.agg(F.sum("fetched")).first()[0]


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = CENTROIDS, dims: int = DIMS,
    rounds: int = ROUNDS, scale: int = SCALE, bits: int = BITS, fetches: list[int] | None = None,
) -> DataFrame:
    """One row per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``fetches``, if given, receives how many vectors each round fetched.
    """
    if not 1 <= bits <= 8:
        raise ValueError("a cell has 1 to 8 bits")
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    source = whole_vectors(vectors, id_col, vec_col, dims, scale)
    chance = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    first = source.select(chance.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(count).collect()
    if not first:
        return spark.createDataFrame([], f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)

    shares = ", ".join(str(i / (1 << bits)) for i in range(1, 1 << bits))
    facts = [f"struct(percentile_approx(v[{d}], array({shares}), 1000) as b, min(v[{d}]) as l, max(v[{d}]) as h)" for d in range(dims)]
    found = source.selectExpr("v").agg(F.expr("count(1)"), *[F.expr(f) for f in facts]).first()
    size, marks = found[0], found[1:]
    cells = Cells([m["b"] for m in marks], [m["l"] for m in marks], [m["h"] for m in marks], bits)

    arrow_id = to_arrow_type(vectors.schema[id_col].dataType)
    numbered = source.withColumn("row", F.monotonically_increasing_id())
    index = words.stored(numbered.mapInArrow(_encoded(cells, arrow_id), f"row long, id {id_type}, cells binary, vec binary"))

    state, total = None, None
    for _ in range(rounds):
        state, total, fetched = _round(index, state, Bounds(cells, centroids), total, size)
        if fetches is not None:
            fetches.append(fetched)
        filled = total[:, 0] > 0
        centroids = np.where(filled[:, None], total[:, 1:] // np.maximum(total[:, :1], 1), centroids)

    last = words.stored(index.select("id", "cells", "vec").mapInArrow(_distances(Bounds(cells, centroids), arrow_id), f"id {id_type}, cluster int, distance long"))
    spread = {r["cluster"]: r["d"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, spread[c], sum(spread.values()), digests[c]) for c in sorted(spread)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    named = last.join(F.broadcast(facts), "cluster")
    return named.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
