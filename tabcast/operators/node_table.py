"""The nodes of a tree ensemble as a table, and scores of single trees read from it.

The nodes come from the model's data as its ML writer saves it. Whole Arrow
batches walk down all trees of a block at once; a block's nodes are broadcast
and number at most ``BLOCK_NODES``, unless one tree alone has more.
"""

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabcast.operators.order import checkpoint_folder

# Nodes broadcast at one time; a node takes about 40 bytes.
BLOCK_NODES = 1_000_000
# Row and tree pairs that one step holds.
_AT_ONCE = 1 << 20
# Cells between thresholds for which a task keeps what it has found.
CELLS = 1 << 18


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """(tree, node, feature, threshold, categories, left_node, right_node, prediction, weight, gain) of a saved model.

    Leaves have no feature. A split goes left up to its threshold, or for
    values among its categories. ``weight`` is the weighted number of
    training rows in the node.
    """
    node = F.col("nodeData")
    inner, split = node["leftChild"] >= 0, node["split"]
    ordered = split["numCategories"] < 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner & ordered, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner & ~ordered, split["leftCategoriesOrThreshold"]).alias("categories"),
        F.when(inner, node["leftChild"]).alias("left_node"), F.when(inner, node["rightChild"]).alias("right_node"),
        node["prediction"].alias("prediction"), F.get(node["impurityStats"], F.lit(0)).alias("weight"), node["gain"].alias("gain"),
    )


def nodes_of(spark: SparkSession, model) -> DataFrame:
    """The node table of a fitted ensemble, by way of the shared folder."""
    path = f"{checkpoint_folder(spark)}/ensemble-{uuid.uuid4().hex}"
    model.write().save(path)
    return node_table(spark, path)


@dataclass
class Walker:
    """Trees as arrays: children are places in them, leaves have feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    categories: dict[int, np.ndarray]

    @classmethod
    def of(cls, rows: pa.Table) -> "Walker":
        """From node rows sorted by tree and node; nodes of a tree number from zero."""
        columns = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in rows.column_names if c != "categories"}
        first = np.flatnonzero(np.append(True, columns["tree"][1:] != columns["tree"][:-1]))
        base = np.repeat(first, np.diff(np.append(first, len(rows))))
        if (columns["node"] != np.arange(len(rows)) - base).any():
            raise ValueError("nodes of a tree are not numbered one by one")

        def place(name):
            return np.nan_to_num(columns[name].astype(float), nan=0).astype(np.int64) + base

        feature = np.nan_to_num(columns["feature"].astype(float), nan=-1).astype(np.int32)
        found = {i: np.array(c) for i, c in enumerate(rows.column("categories").to_pylist()) if c is not None}
        return cls(first, feature, columns["threshold"].astype(float), place("left_node"), place("right_node"), columns["prediction"].astype(float), found)

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        """The prediction of every tree (columns) for every row."""
        step = max(1, _AT_ONCE // len(self.roots))
        parts = [self._walk(matrix[at : at + step]) for at in range(0, len(matrix), step)]
        return np.concatenate(parts) if parts else np.empty((0, len(self.roots)))

    def _walk(self, matrix: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(matrix), len(self.roots))).copy()
        while True:
            row, tree = np.nonzero(self.feature[at] >= 0)
            if not len(row):
                return self.value[at]
            node = at[row, tree]
            x = matrix[row, self.feature[node]]
            lower = x <= self.threshold[node]
            if self.categories:
                for i in np.intersect1d(node, list(self.categories)):
                    here = node == i
                    lower[here] = np.isin(x[here], self.categories[i])
            at[row, tree] = np.where(lower, self.left[node], self.right[node])


class Cells:
    """What rows get that lie between the same thresholds of all features, found once for each such cell."""

    def __init__(self, walker: Walker, found):
        """``found`` makes a row of results of each row of tree scores."""
        split = walker.feature >= 0
        self.walker, self.found = walker, found
        self.cuts = {f: np.unique(walker.threshold[split & (walker.feature == f)]) for f in np.unique(walker.feature[split])}
        self.size = 1
        for cuts in self.cuts.values():
            self.size *= len(cuts) + 1
        # Sets of categories have no order; more cells are not worth a table.
        if walker.categories or self.size > CELLS:
            self.size = 0
        self.place, self.rows = np.full(self.size, -1, np.int32), None

    def __call__(self, matrix: np.ndarray) -> np.ndarray:
        if not self.size:
            return self._walked(matrix)
        cell = np.zeros(len(matrix), np.int64)
        for f, cuts in self.cuts.items():
            cell = cell * (len(cuts) + 1) + np.searchsorted(cuts, matrix[:, f])
        fresh = np.flatnonzero(self.place[cell] < 0)
        if len(fresh) or self.rows is None:
            new, first = np.unique(cell[fresh], return_index=True)
            rows = self._walked(matrix[fresh[first]])
            self.place[new] = np.arange(len(new)) + (0 if self.rows is None else len(self.rows))
            self.rows = rows if self.rows is None else np.concatenate([self.rows, rows])
        return self.rows[self.place[cell]]

    def _walked(self, matrix: np.ndarray) -> np.ndarray:
        step = max(1, _AT_ONCE // len(self.walker.roots))
        return np.concatenate([self.found(self.walker.scores(matrix[at : at + step])) for at in range(0, max(len(matrix), 1), step)])


def _blocks(nodes: DataFrame) -> list[tuple[int, int]]:
    """Runs of trees (first, last) whose nodes may be broadcast together."""
    sizes = sorted(tuple(r) for r in nodes.groupBy("tree").count().collect())
    blocks, held = [], 0
    for tree, size in sizes:
        if blocks and held + size <= BLOCK_NODES:
            blocks[-1], held = (blocks[-1][0], tree), held + size
        else:
            blocks.append((tree, tree))
            held = size
    return blocks


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), len(flat) // max(len(vectors), 1))


def _walking(walker):
    def walk(vectors: pa.Array) -> pa.Array:
        scores = walker.value.scores(_matrix(vectors))
        ends = np.arange(len(vectors) + 1) * scores.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(scores.ravel()))

    return walk


def _broadcast(nodes: DataFrame, first: int, last: int):
    rows = nodes.where(F.col("tree").between(first, last)).orderBy("tree", "node").toArrow()
    return nodes.sparkSession.sparkContext.broadcast(Walker.of(rows))


def _quantile(ordered: np.ndarray, share: float) -> np.ndarray:
    place = share * (ordered.shape[1] - 1)
    low = int(place)
    first, second = ordered[:, low], ordered[:, min(low + 1, ordered.shape[1] - 1)]
    return first + (place - low) * (second - first)


def mean_and_quantiles(nodes: DataFrame, df: DataFrame, shares: list[float], features: str = "features") -> Column | None:
    """A struct of the mean of all trees (m) and interpolated quantiles among them (q0, q1, ...); None if the trees take several broadcasts."""
    blocks = _blocks(nodes)
    if len(blocks) != 1:
        return None
    walker, kept = _broadcast(nodes, *blocks[0]), []
    names = ["m", *[f"q{i}" for i in range(len(shares))]]

    def found(scores: np.ndarray) -> np.ndarray:
        ordered = np.sort(scores, axis=1)
        # One tree after the other, as Spark ML adds them.
        mean = np.add.accumulate(scores, axis=1)[:, -1] / scores.shape[1]
        return np.column_stack([mean, *[_quantile(ordered, s) for s in shares]])

    def walk(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.StructArray.from_arrays([pa.array([], pa.float64())] * len(names), names)
        if not kept:
            kept.append(Cells(walker.value, found))
        rows = kept[0](_matrix(vectors))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names)

    return F.arrow_udf(walk, f"struct<{', '.join(f'{n}: double' for n in names)}>")(vector_to_array(features))


def score_by_tree(nodes: DataFrame, df: DataFrame, features: str = "features", name: str = "by_tree") -> DataFrame:
    """Add ``name``, the array of single-tree predictions in the order of the trees."""
    parts = []
    for first, last in _blocks(nodes):
        walk = _walking(_broadcast(nodes, first, last))
        parts.append(F.arrow_udf(walk, "array<double>")(vector_to_array(features)))
    return df.withColumn(name, F.concat(*parts))


def importances_from_nodes(nodes: DataFrame, per_tree: bool = True) -> DataFrame:
    """(feature, importance): impurity gains weighted by rows, scaled to one.

    A forest scales the gains of each tree first; boosting (``per_tree=False``) adds them as they are.
    """
    gains = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    if per_tree:
        whole = gains.groupBy("tree").agg(F.sum("gain").alias("of_tree")).where("of_tree > 0")
        gains = gains.join(whole, "tree").withColumn("gain", F.col("gain") / F.col("of_tree"))
    shares = gains.groupBy("feature").agg(F.sum("gain").alias("share"))
    # As many rows as features.
    return shares.select("feature", (F.col("share") / F.sum("share").over(Window.partitionBy())).alias("importance"))
