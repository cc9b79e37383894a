"""Forests and boosting by Spark ML, their importances, folds and tree intervals."""

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabcast.operators import cell_forest, evaluate, node_table

TREES = 120
SEED = 42
# Bytes of the points cached for a fit that one task may read in one pass.
PART_BYTES = 1 << 28
# Bytes of all points from which a forest grows from cells, if it can.
MANY_BYTES = 1 << 30


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def forest(target: str, trees: int = TREES, depth: int = 10, seed: int = SEED) -> RandomForestRegressor:
    """Forest that may use every feature at each split; Spark caps depth at 30."""
    return RandomForestRegressor(
        featuresCol="features", labelCol=target, predictionCol="pred", numTrees=trees,
        maxDepth=depth, featureSubsetStrategy="all", seed=seed,
    )


def boosting(target: str, rounds: int = TREES, depth: int = 3, step: float = 0.1, seed: int = SEED) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol=target, predictionCol="pred", maxIter=rounds,
        maxDepth=depth, stepSize=step, seed=seed,
    )


def point_bytes(estimator, features: int) -> int:
    """Bytes that a task reads for each row in a pass of a fit, rounded up.

    Spark ML caches a row as its binned features and, in a forest, one sample
    count for each tree. A round of boosting reads points, counts and errors
    to update the errors, and again to grow the next tree.
    """
    point = 128 + 4 * features
    return point + 4 * estimator.getNumTrees() if isinstance(estimator, RandomForestRegressor) else 3 * point


def feature_count(rows: DataFrame, features: str) -> int:
    """Length of the vectors, by their metadata or else by the first one."""
    known = rows.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    if known is None:
        first = rows.select(features).first()
        known = first[0].size if first and first[0] is not None else 0
    return known


def spread(rows: DataFrame, estimator) -> DataFrame:
    """Deal ``rows`` out where they lie in fewer partitions than there are cores or one holds too many for a task.

    A task of a fit reads all points of a partition, so the number of
    partitions grows with the rows, and what one task reads does not.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    most = max(1, PART_BYTES // point_bytes(estimator, feature_count(rows, estimator.getFeaturesCol())))
    held = rows.groupBy(F.spark_partition_id().alias("part")).count()
    found = held.agg(F.max("count").alias("largest"), F.sum("count").alias("rows")).first()
    if rows.rdd.getNumPartitions() >= cores and (found["largest"] or 0) <= most:
        return rows
    return rows.repartition(max(cores, math.ceil((found["rows"] or 0) / most)))


def fit(estimator, rows: DataFrame):
    """Fit on rows kept in memory (or on disk) for the many passes of a tree model, spread among tasks first.

    Forests of many rows grow from cells instead, in one pass.
    """
    rows = rows.select(estimator.getFeaturesCol(), estimator.getLabelCol())
    features = feature_count(rows, estimator.getFeaturesCol())
    if cell_forest.grows(estimator, rows, features) and rows.count() * point_bytes(estimator, features) > MANY_BYTES:
        return cell_forest.fit(estimator, rows, features)
    kept = spread(rows, estimator).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(kept)
    finally:
        kept.unpersist()


def cross_validate(df: DataFrame, target: str, fold: str, estimator, parallel: int = 4) -> DataFrame:
    """(fold, n, r2) with one fit per fold; ``df`` already has ``features``.

    The matrix is computed once and kept; up to ``parallel`` folds are fitted
    and scored side by side, and share the cluster.
    """
    kept = spread(df.select(fold, estimator.getFeaturesCol(), target), estimator).persist(StorageLevel.MEMORY_AND_DISK)

    @inheritable_thread_target(df.sparkSession)
    def score(held) -> tuple:
        model = estimator.fit(kept.where(F.col(fold) != held))
        found = evaluate.metrics(model.transform(kept.where(F.col(fold) == held)), target, "pred").first()
        return held, found["n"], found["r2"]

    try:
        folds = sorted(r[0] for r in kept.select(fold).distinct().collect())
        with ThreadPoolExecutor(parallel) as pool:
            rows = list(pool.map(score, folds))
    finally:
        kept.unpersist()
    kind = df.schema[fold].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"fold {kind}, n bigint, r2 double")


def importances(spark, features: list[str], weights) -> DataFrame:
    """(feature, importance): impurity of a tree model or size of a coefficient."""
    rows = [(name, abs(float(w))) for name, w in zip(features, weights)]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_importance(found: DataFrame, k: int = 12) -> DataFrame:
    """Largest importances, those above the mean of the shown ones marked."""
    best = found.orderBy(F.desc("importance"), "feature").limit(k)
    return best.withColumn("above_mean", F.col("importance") > F.avg("importance").over(Window.partitionBy()))


def tree_predictions(model, df: DataFrame) -> DataFrame:
    """Add ``pred`` and ``by_tree``, the array of single-tree predictions read from the model's node table."""
    return node_table.score_by_tree(node_table.nodes_of(df.sparkSession, model), model.transform(df))


def array_quantile(ordered: Column, share: float, size: int) -> Column:
    """Interpolated quantile of a sorted array of known size."""
    place = share * (size - 1)
    low = int(place)
    first, second = F.get(ordered, F.lit(low)), F.get(ordered, F.lit(min(low + 1, size - 1)))
    return first + F.lit(place - low) * (second - first)


def tree_interval(model, df: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Add ``pred``, ``ci_low`` and ``ci_high`` from the spread of a forest's trees."""
    size = model.getNumTrees
    if isinstance(model, RandomForestRegressionModel) and model.getPredictionCol() == "pred":
        # Its prediction is the mean of its trees; rows between the same thresholds share all three.
        found = node_table.mean_and_quantiles(node_table.nodes_of(df.sparkSession, model), df, [low, high], model.getFeaturesCol())
        if found is not None:
            return df.withColumn("_found", found).withColumns({
                "pred": F.col("_found.m"), "ci_low": F.col("_found.q0"), "ci_high": F.col("_found.q1"),
            }).drop("_found")
    rows = tree_predictions(model, df).withColumn("by_tree", F.sort_array("by_tree"))
    return rows.withColumns({
        "ci_low": array_quantile(F.col("by_tree"), low, size),
        "ci_high": array_quantile(F.col("by_tree"), high, size),
    }).drop("by_tree")
