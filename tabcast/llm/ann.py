"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt into shards. In each shard every tree hashes a vector to a
string of ``BITS`` signs of random projections and keeps the strings in a
sorted array. A query descends all trees to the longest prefix that a string
shares with its own, and then all trees ascend together, one bit at a time,
until the runs of strings under the current prefixes hold ``share`` of the
shard. The distinct rows in these runs are compared exactly.

The stated queries are dealt into blocks, and each block meets each shard
once; the best of a query in each shard are ranked together at the end. A
shard is bounded in rows, a block in queries, so no group grows with the
table; a very common vector is spread over all shards.

Inner products rank like cosines once every row has one more component that
brings it to the length of the shard's longest row (and queries have zero
there); the trees hash these longer vectors.

Defined cases: rows with a null id, and vectors that are null, zero or hold
null or non-finite components, take no part. Vectors meet only those of their
own length. Rows with the query's id are its own. A query id that repeats is
a query each time. Ties go to the smaller id, then to any row.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES = 56
BITS = 24
SHARE = 0.6
LEAST = 1_000
TOP = 20
EVERY = 20
SEED = 17
# Rows of a shard: as few as MIN_ROWS while there are idle cores, MAX_ROWS at most on average.
MIN_ROWS, MAX_ROWS = 8_192, 131_072
BLOCK = 4_096
# Scores this close to the last place are compared again, component by component.
_NEAR = 1e-9


class Forest:
    """Sorted arrays of hash strings over the rows of one shard."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.vectors, self.bits = vectors, bits
        n, width = vectors.shape
        self.planes = np.random.default_rng(seed).standard_normal((width + 1, trees * bits))
        squares = (vectors * vectors).sum(axis=1)
        rest = np.sqrt(np.maximum(0, squares.max() - squares))[:, None]
        strings = self._strings(np.hstack([vectors, rest]))
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def _strings(self, longer: np.ndarray) -> np.ndarray:
        """(trees, rows) hash strings, first bit highest."""
        trees = self.planes.shape[1] // self.bits
        out = np.empty((trees, len(longer)), np.int64)
        weights = 1 << np.arange(self.bits - 1, -1, -1)
        for t in range(trees):
            out[t] = (longer @ self.planes[:, t * self.bits : (t + 1) * self.bits] > 0) @ weights
        return out

    def runs(self, queries: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) starts and ends of the runs at which each query's ascent stops."""
        strings = self._strings(np.hstack([queries, np.zeros((len(queries), 1))]))
        low, high = np.zeros_like(strings), np.zeros_like(strings)
        todo = np.arange(len(queries))
        for left in range(self.bits + 1):
            # ``left`` last bits are free.
            first = strings[:, todo] >> left << left
            for t, row in enumerate(self.sorted):
                low[t, todo] = np.searchsorted(row, first[t])
                high[t, todo] = np.searchsorted(row, first[t] + (1 << left))
            todo = todo[(high[:, todo] - low[:, todo]).sum(axis=0) < least]
            if not len(todo):
                break
        return low, high

    def search(self, queries: np.ndarray, least: int):
        """For each query the row numbers met in any tree."""
        low, high = self.runs(queries, least)
        seen = np.empty(len(self.vectors), bool)
        for q in range(len(queries)):
            seen[:] = False
            for t in range(len(low)):
                seen[self.order[t, low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(seen)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, so equal vectors have equal scores."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += rows[:, j] * query[j]
    return total


def _best(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``top`` largest products, ties to smaller ids."""
    rough = rows @ query
    if len(rough) > top:
        near = np.flatnonzero(rough >= np.partition(rough, -top)[-top] - _NEAR * max(1.0, np.abs(rough).max()))
    else:
        near = np.arange(len(rough))
    scores = products(rows[near], query)
    order = np.lexsort((ids[near], -scores))[:top]
    return near[order], scores[order]


def _search(top: int, share: float, trees: int, bits: int, seed: int):
    """Cogrouped function: the best of a shard's rows for each query of a block."""

    def searched(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["q", "query_id", "vec_id", "score"]
        if rows.empty or queries.empty:
            return pd.DataFrame(columns=columns)
        rows = rows.sort_values("vec_id", kind="stable")
        ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float)
        asked = np.stack(queries["v"].to_numpy()).astype(float)
        forest = Forest(vectors, trees, bits, seed)
        out = []
        found = forest.search(asked, max(LEAST, int(share * len(ids))))
        for q, own, query, met in zip(queries["q"], queries["query_id"], asked, found):
            met = met[ids[met] != own]
            places, scores = _best(vectors[met], ids[met], query, top)
            out.append(pd.DataFrame({"q": q, "query_id": own, "vec_id": ids[met[places]], "score": scores}))
        return pd.concat(out)[columns]

    return searched


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, top: int = TOP, share: float = SHARE,
    trees: int = TREES, bits: int = BITS, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each row whose id is divisible by ``every``."""
    v = F.col("v")
    clean = (
        vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
        .where("vec_id is not null and v is not null")
        .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
        .withColumns({"w": F.size("v"), "q": F.monotonically_increasing_id()})
    )
    counts = clean.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-counts[0] // MAX_ROWS), min(-(-counts[0] // MIN_ROWS), 2 * cores))
    blocks = max(1, -(-counts[1] // BLOCK))
    cell = ["w", "shard", "block"]
    every_block, every_shard = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(shards - 1))
    # Consecutive rows go to different shards, whatever their ids or vectors.
    rows = clean.withColumn("shard", F.pmod("q", F.lit(shards)).cast("int")).select("w", "shard", F.explode(every_block).alias("block"), "vec_id", "v")
    asked = clean.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    asked = asked.select("w", F.explode(every_shard).alias("shard"), "block", "q", F.col("vec_id").alias("query_id"), "v")
    parts = shards * blocks
    cells = rows.repartition(parts, *cell).groupBy(*cell).cogroup(asked.repartition(parts, *cell).groupBy(*cell))
    found = cells.applyInPandas(_search(top, share, trees, bits, seed), "q long, query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
