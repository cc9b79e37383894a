"""Forests grown from sums over cells, and intervals found once a cell."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.operators import cell_forest, evaluate, node_table, trees


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.range(3000).selectExpr(
        "id", "cast(pmod(hash(id), 1000) as double) / 10 as a", "cast(pmod(hash(id, 1), 7) as double) as b", "cast(pmod(hash(id, 2), 29) as double) as c")
    return trees.assemble(rows.withColumn("y", F.col("a") * F.col("b") + F.sin("c") * 20).repartition(4), ["a", "b", "c"]).cache()


def listed(rows):
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("depth", [0, 1, 4, 12])
def test_one_tree_is_spark_ml_s(spark, folder, depth):
    """With every row counted once, and few values a feature, a tree has the nodes of Spark's decision tree."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 12, 2000), rng.integers(0, 3, 2000), rng.integers(0, 30, 2000)]).astype(float)
    y = np.rint(x[:, 0] * x[:, 1] + 8 * np.sin(x[:, 2]))
    df = trees.assemble(spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, y double"), ["a", "b", "c"])
    DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=depth).fit(df).write().save(f"{folder}/tree")
    want = listed(spark.read.parquet(f"{folder}/tree/data").collect())
    cuts = [(np.unique(v)[1:] + np.unique(v)[:-1]) / 2 for v in x.T]
    batches = [pa.RecordBatch.from_arrays([pa.array(v.tolist()), pa.array(t)], ["x", "y"]) for v, t in zip(np.split(x, 4), np.split(y, 4))]
    sums = pa.Table.from_batches(cell_forest._sums(cuts, 1, lambda: lambda n: np.ones((n, 1)))(iter(batches)))
    got = cell_forest._grown(cuts, depth, 1, 0.0)(sums)["nodeData"].to_pylist()
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g["id"], g["leftChild"], g["rightChild"], g["rawCount"]) == (w["id"], w["leftChild"], w["rightChild"], w["rawCount"])
        assert g["split"]["featureIndex"] == w["split"]["featureIndex"] and g["split"]["leftCategoriesOrThreshold"] == w["split"]["leftCategoriesOrThreshold"]
        assert np.allclose([g["prediction"], g["impurity"], g["gain"], *g["impurityStats"]], [w["prediction"], w["impurity"], w["gain"], *w["impurityStats"]], atol=1e-6)


def test_many_rows_are_not_kept(spark, vectors, monkeypatch, folder):
    """A forest of many rows takes them in passes; it holds all rows, a Poisson sample a tree, and predicts as well."""
    estimator = trees.forest("y", trees=30, depth=6)
    usual = trees.fit(estimator, vectors)
    monkeypatch.setattr(trees, "MANY_BYTES", 0, raising=False)

    def never(self, *args):
        raise AssertionError("rows of a large fit are cached")

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "persist", never)
        model = trees.fit(estimator, vectors)
    assert (model.getNumTrees, model.numFeatures, model.getPredictionCol()) == (30, 3, "pred")
    assert abs(model.featureImportances.toArray() - usual.featureImportances.toArray()).max() < 0.05
    roots = [r["weight"] for r in node_table.nodes_of(spark, model).where("node = 0").collect()]
    assert len(roots) == 30 and len(set(roots)) > 15 and all(abs(n - 3000) < 6 * 3000**0.5 for n in roots)
    assert 0.4 * 3000**0.5 < np.std(roots) < 1.8 * 3000**0.5
    r2 = [evaluate.metrics(m.transform(vectors), "y", "pred").first()["r2"] for m in (model, usual)]
    assert r2[0] > r2[1] - 0.02
    model.write().save(f"{folder}/model")
    again = trees.fit(estimator, vectors)
    assert [t.toDebugString.split("\n", 1)[1] for t in again.trees] == [t.toDebugString.split("\n", 1)[1] for t in model.trees]


def test_draws_are_poisson():
    limits = cell_forest._LIMITS.astype(float) / 2**32
    assert np.allclose(np.diff(limits, prepend=0)[:6], [np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)], atol=1e-9)
    edges = np.array([0, cell_forest._LIMITS[0] - 1, cell_forest._LIMITS[0], cell_forest._LIMITS[1], 2**32 - 1], np.uint32)
    assert cell_forest._counts(edges).tolist() == [0, 0, 1, 2, 12]


def test_thresholds(spark):
    rows = spark.range(5000).selectExpr("array(cast(id % 3 as double), cast(id as double), 4.0D, if(id = 7, 1.0D, 0.0D)) as x", "1.0D as y").repartition(3)
    cuts = cell_forest.thresholds(rows, 4, 32)
    assert cuts[0].tolist() == [0.5, 1.5] and cuts[2].tolist() == [] and cuts[3].tolist() == [0.5]
    assert len(cuts[1]) == 31 and np.allclose(cuts[1], np.arange(1, 32) * 5000 / 32, atol=3)


def test_other_estimators_keep_their_fit(spark, vectors):
    for estimator, grows in [(trees.forest("y"), True), (trees.boosting("y"), False), (trees.forest("y", trees=1), False),
                             (trees.forest("y").setFeatureSubsetStrategy("sqrt"), False), (trees.forest("y").setSubsamplingRate(0.5), False),
                             (trees.forest("y").setWeightCol("a"), False), (trees.forest("y").setMaxBins(64), False)]:
        assert cell_forest.grows(estimator, vectors, 3) is grows
    assert not cell_forest.grows(trees.forest("y"), vectors, 4)


@pytest.mark.parametrize("label", ["null", "double('nan')"])
def test_labels_must_be_numbers(spark, vectors, monkeypatch, label):
    monkeypatch.setattr(trees, "MANY_BYTES", 0, raising=False)
    with pytest.raises(Exception, match="must not be null|labels numbers"):
        trees.fit(trees.forest("y", trees=2, depth=2), vectors.withColumn("y", F.expr(f"if(id = 5, {label}, y)")))


@pytest.mark.parametrize(("cells", "block"), [(1 << 18, 1_000_000), (10, 1_000_000), (1 << 18, 300)])
def test_interval_of_a_cell_is_that_of_its_rows(spark, vectors, monkeypatch, cells, block):
    """The same bits as the forest's own predictions and sorted trees."""
    monkeypatch.setattr(node_table, "CELLS", cells)
    monkeypatch.setattr(node_table, "BLOCK_NODES", block)
    model = trees.fit(trees.forest("y", trees=41, depth=5), vectors)
    want = {r["id"]: (r["pred"], sorted(r["by_tree"])) for r in trees.tree_predictions(model, vectors).collect()}
    got = trees.tree_interval(model, vectors, 0.05, 0.9).collect()
    assert len(got) == 3000
    for r in got:
        pred, ordered = want[r["id"]]
        # 40 steps between 41 trees: places 2 and 36.
        assert (r["pred"], r["ci_low"], r["ci_high"]) == (pred, ordered[2], ordered[36])


def test_cells_tell_all_rows_apart():
    """Values on a threshold, beyond all and missing, in small batches."""
    table = pa.table({
        "tree": [0, 0, 0, 1, 1, 1], "node": [0, 1, 2, 0, 1, 2], "feature": pa.array([0, None, None, 1, None, None]), "threshold": [1.0, None, None, 2.0, None, None],
        "categories": pa.array([None] * 6, pa.list_(pa.float64())), "left_node": [1, None, None, 1, None, None], "right_node": [2, None, None, 2, None, None],
        "prediction": [0.0, 1.0, 2.0, 0.0, 10.0, 20.0],
    })
    walker = node_table.Walker.of(table)
    cells = node_table.Cells(walker, lambda scores: scores)
    x = np.array(list(itertools.product([0.0, 1.0, 1.5, np.nan], [2.0, 2.5, -np.inf])))
    for part in (x[:1], x[:5], x, x[:0]):
        assert np.array_equal(cells(part), walker.scores(part).reshape(-1, 2))
    assert cells.size == 4 and len(cells.rows) == 4
