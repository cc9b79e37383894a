"""Forests of large tables, grown from sums over cells of binned features.

Spark ML caches every row beside one sample count a tree and reads all of it
again for each level. Here one pass bins the rows, draws their sample counts
and sums counts, labels and squares by tree and cell; each tree then grows
from its cells by Spark ML's rules, as a task of its own. A split asks only
for sums by bin, so nothing is lost. Thresholds come from all rows: between
all values of a feature where these are few, else at even shares. The result
is a Spark ML model, loaded from the format it saves.
"""

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.operators.order import checkpoint_folder

# Cells that a task sums, for each tree.
CELLS = 1 << 15
# Partial sums that reach the exchange, for each core.
_TASKS = 4
# Rows whose counts are drawn at one time.
_AT_ONCE = 1 << 14
# Where a whole number of 32 bits passes from one Poisson count (of mean 1) to the next; higher counts have less than one part in 2 ** 32.
_LIMITS = np.array([round(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(12)], np.uint64).clip(max=2**32 - 1).astype(np.uint32)
_SUMS_SQL = "tree int, cell int, n double, s double, q double"
_NODES_SQL = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def grows(estimator, rows: DataFrame, features: int) -> bool:
    """Whether the estimator is a forest that grows from cells: bootstrap samples, all features at each split, ordered features only."""
    if not isinstance(estimator, RandomForestRegressor) or not features or estimator.getMaxBins() ** features > CELLS:
        return False
    attrs = rows.schema[estimator.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
    plain = not attrs.get("nominal") and not attrs.get("binary") and not estimator.isDefined(estimator.weightCol)
    # One tree alone takes each row once.
    return (
        plain and estimator.getNumTrees() > 1 and estimator.getBootstrap() and estimator.getSubsamplingRate() == 1.0
        and estimator.getFeatureSubsetStrategy() == "all" and estimator.getMinWeightFractionPerNode() == 0.0
    )


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _checked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    if any(c.null_count for c in batch.columns):
        raise ValueError("features and labels must not be null")
    x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
    if not np.isfinite(x).all() or np.isnan(y).any():
        raise ValueError("features must be finite and labels numbers")
    return x, y


def _few(most: int):
    """(feature, value): the different values of each feature, ``most`` at most in a task."""

    def scan(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                x, _ = _checked(batch)
                held = held or [np.empty(0)] * x.shape[1]
                held = [h if len(h) >= most else np.union1d(h, x[:, f])[:most] for f, h in enumerate(held)]
        for f, h in enumerate(held or []):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), f, np.int32)), pa.array(h)], ["f", "v"])

    return scan


def thresholds(points: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Ascending limits of the bins of each feature; a value up to a limit lies below it."""
    seen = points.mapInArrow(_few(bins + 1), "f int, v double").distinct()
    few = {r["f"]: sorted(r["v"]) for r in seen.groupBy("f").agg(F.slice(F.collect_set("v"), 1, bins + 1).alias("v")).collect()}
    cuts = {f: np.add(v[1:], v[:-1]) / 2 for f, v in few.items() if len(v) <= bins}
    many = [f for f in range(features) if f not in cuts]
    if many:
        shares = [i / bins for i in range(1, bins)]
        found = points.agg(*[F.percentile_approx(F.get("x", F.lit(f)), shares, 10_000) for f in many]).first()
        cuts |= {f: np.unique(v) for f, v in zip(many, found)}
    return [cuts[f] for f in range(features)]


def _sums(cuts: list[np.ndarray], trees: int, draw):
    """Sums of counts, labels and squares by tree and cell.

    ``draw`` is called once in a task and gives what makes the counts (rows, trees) for a number of rows.
    """
    shape = [len(c) + 1 for c in cuts]

    def scan(batches):
        totals, counts = np.zeros((3, math.prod(shape), trees)), draw()
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                x, y = _checked(batch.slice(at, _AT_ONCE))
                cell = np.ravel_multi_index([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], shape)
                order = np.argsort(cell, kind="stable")
                cell, y = cell[order], y[order, None]
                starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                weights = counts(len(cell)).astype(float)
                for power in range(3):
                    if power:
                        weights *= y
                    totals[power, cell[starts]] += np.add.reduceat(weights, starts, axis=0)
        for tree in range(trees):
            cell = np.flatnonzero(totals[0, :, tree])
            columns = [np.full(len(cell), tree, np.int32), cell.astype(np.int32), *totals[:, cell, tree]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "cell", "n", "s", "q"])

    return scan


def _counts(drawn: np.ndarray) -> np.ndarray:
    counts = np.zeros(drawn.shape, np.uint8)
    for limit in _LIMITS:
        counts += drawn >= limit
    return counts


def _drawn(seed: int, trees: int):
    def draw():
        rng = np.random.default_rng([seed % (1 << 64), TaskContext.get().partitionId()])
        return lambda rows: _counts(rng.integers(0, 1 << 32, (rows, trees), np.uint32))

    return draw


def _variance(sums: np.ndarray) -> np.ndarray:
    """Of sums of counts, labels and squares, in the last axis but one."""
    n, s, q = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, (q - s * s / n) / n, 0.0)


def _grown(cuts: list[np.ndarray], depth: int, least: int, least_gain: float):
    """Nodes of one tree from its sums by cell, numbered parent first."""
    shape = [len(c) + 1 for c in cuts]

    def best(bins: np.ndarray, sums: np.ndarray, whole: np.ndarray, impurity: float):
        """(gain, feature, place of the threshold) of the first best split."""
        found = (0.0, -1, -1)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            left = np.stack([np.bincount(bins[f], s, shape[f]) for s in sums]).cumsum(axis=1)[:, :-1]
            right = whole[:, None] - left
            gains = impurity - left[0] / whole[0] * _variance(left) - right[0] / whole[0] * _variance(right)
            gains[(left[0] < least) | (right[0] < least) | (gains < least_gain)] = -1.0
            at = int(np.argmax(gains))
            if gains[at] > found[0]:
                found = (float(gains[at]), f, at)
        return found

    def node(bins: np.ndarray, sums: np.ndarray, level: int) -> list[list]:
        """[prediction, impurity, sums, gain, size of the left branch, feature, threshold], then the branches; leaves have no feature."""
        whole = sums.sum(axis=1)
        impurity = float(_variance(whole))
        leaf = [[whole[1] / whole[0], impurity, whole, -1.0, 0, -1, 0.0]]
        if level == depth or level and abs(impurity) < np.finfo(float).eps:
            return leaf
        gain, f, at = best(bins, sums, whole, impurity)
        if f < 0:
            return leaf
        below = bins[f] <= at
        left, right = (node(bins[:, part], sums[:, part], level + 1) for part in (below, ~below))
        if len(left) == len(right) == 1 and left[0][0] == right[0][0]:
            return [[left[0][0], *leaf[0][1:]]]
        return [[*leaf[0][:3], gain, len(left), f, float(cuts[f][at])], *left, *right]

    def grow(rows: pa.Table) -> pa.Table:
        bins = np.array(np.unravel_index(rows["cell"].to_numpy(), shape))
        sums = np.stack([rows[c].to_numpy() for c in ("n", "s", "q")])
        tree, out = rows["tree"][0].as_py(), []
        for i, (prediction, impurity, whole, gain, size, f, cut) in enumerate(node(bins, sums, 0)):
            split = {"featureIndex": f, "leftCategoriesOrThreshold": [cut] if f >= 0 else [], "numCategories": -1}
            out.append({
                "id": i, "prediction": prediction, "impurity": impurity, "impurityStats": whole.tolist(), "rawCount": round(whole[0]), "gain": gain,
                "leftChild": i + 1 if f >= 0 else -1, "rightChild": i + 1 + size if f >= 0 else -1, "split": split,
            })
        return pa.table({"treeID": pa.array([tree] * len(out), pa.int32()), "nodeData": pa.array(out, _NODE)})

    return grow


_NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
    ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
])


def fit(estimator: RandomForestRegressor, rows: DataFrame, features: int) -> RandomForestRegressionModel:
    """The forest of all rows; ``grows`` tells for which estimators."""
    spark, label = rows.sparkSession, estimator.getLabelCol()
    points = rows.select(vector_to_array(estimator.getFeaturesCol()).alias("x"), rows[label].cast("double").alias("y"))
    tasks = _TASKS * spark.sparkContext.defaultParallelism
    if points.rdd.getNumPartitions() > tasks:
        points = points.coalesce(tasks)
    cuts, trees = thresholds(points, features, estimator.getMaxBins()), estimator.getNumTrees()
    sums = points.mapInArrow(_sums(cuts, trees, _drawn(estimator.getSeed(), trees)), _SUMS_SQL)
    sums = sums.groupBy("tree", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    grow = _grown(cuts, estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getMinInfoGain())
    nodes = sums.groupBy("tree").applyInArrow(grow, _NODES_SQL)
    # A forest of few rows gives the rest of the format: parameters, trees and their weights.
    small = spark.createDataFrame([(Vectors.dense([float(i)] * features), float(i)) for i in range(40)], [estimator.getFeaturesCol(), label])
    path = f"{checkpoint_folder(spark)}/forest-{uuid.uuid4().hex}"
    estimator.fit(small).write().save(path)
    nodes.write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)
