"""Node tables of tree models, their scores, importances and folds; densities; saved models."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.sql import functions as F

from tabcast.operators import evaluate, linear, node_table, shape, trees
from tabcast.plans import workflow
from tabcast.sources import runs


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.range(2500).selectExpr(
        "id", "cast(pmod(hash(id), 1000) as double) / 10 as a", "cast(pmod(hash(id, 1), 7) as double) as b", "cast(pmod(hash(id, 2), 50) as double) as c")
    rows = rows.withColumn("y", F.col("a") * F.col("b") + F.sin("c") * 20).repartition(4)
    return trees.assemble(rows, ["a", "b", "c"]).cache()


def single(model, rows):
    """Predictions of every tree by its own ``transform``."""
    found = rows.select("id", "features")
    for i, tree in enumerate(model.trees):
        found = tree.copy().setPredictionCol(f"t{i}").transform(found)
    return {r["id"]: list(r)[2:] for r in found.collect()}


@pytest.mark.parametrize("block", [1_000_000, 900])
def test_all_trees_of_a_deep_forest(vectors, monkeypatch, block):
    """120 trees of depth 10, in one broadcast and in many."""
    monkeypatch.setattr(node_table, "BLOCK_NODES", block)
    monkeypatch.setattr(node_table, "_AT_ONCE", 50_000)
    model = trees.fit(trees.forest("y"), vectors)
    rows = vectors.where("id % 25 = 0")
    got = {r["id"]: r for r in trees.tree_predictions(model, rows).select("id", "by_tree", "pred").collect()}
    want = {}
    for at in range(0, 120, 20):  # few trees at a time, or the plan grows too large
        part = model.trees[at : at + 20]
        found = rows.select("id", "features")
        for i, tree in enumerate(part):
            found = tree.copy().setPredictionCol(f"t{i}").transform(found)
        for r in found.collect():
            want.setdefault(r["id"], []).extend(list(r)[2:])
    assert {i: r["by_tree"] for i, r in got.items()} == want
    assert all(abs(np.mean(r["by_tree"]) - r["pred"]) < 1e-9 for r in got.values())


def test_boosting_adds_up(spark, vectors):
    model = trees.fit(trees.boosting("y", rounds=12), vectors)
    scored = node_table.score_by_tree(node_table.nodes_of(spark, model), model.transform(vectors))
    for r in scored.select("by_tree", "pred").limit(200).collect():
        assert abs(np.dot(model.treeWeights, r["by_tree"]) - r["pred"]) < 1e-9


def test_categories(spark, vectors):
    """Splits by sets of categories, as Spark ML makes for indexed columns."""
    assembled = VectorAssembler(inputCols=["b", "a"], outputCol="raw").transform(vectors.drop("features"))
    indexed = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=10).fit(assembled).transform(assembled)
    model = trees.fit(trees.forest("y", trees=6, depth=5), indexed)
    nodes = node_table.nodes_of(spark, model)
    assert nodes.where("categories is not null").count() > 0 and nodes.where("feature is null").count() > 0
    got = {r["id"]: r["by_tree"] for r in node_table.score_by_tree(nodes, indexed).select("id", "by_tree").collect()}
    assert got == single(model, indexed)


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_importances(spark, vectors, kind):
    model = trees.fit(trees.forest("y", trees=9, depth=4) if kind == "forest" else trees.boosting("y", rounds=9), vectors)
    got = {r["feature"]: r["importance"] for r in node_table.importances_from_nodes(node_table.nodes_of(spark, model), kind == "forest").collect()}
    want = model.featureImportances.toArray()
    assert np.allclose([got.get(i, 0.0) for i in range(3)], want, atol=1e-9)
    names = {r["feature"]: r["importance"] for r in trees.importances(spark, ["a", "b", "c"], want).collect()}
    assert names == dict(zip("abc", want.tolist()))


def test_folds_side_by_side(vectors):
    """The same scores as one fit after the other."""
    folds = evaluate.kfold(vectors, "id", 3)
    estimator = trees.forest("y", trees=5, depth=4)
    got = {r["fold"]: (r["n"], r["r2"]) for r in trees.cross_validate(folds, "y", "fold", estimator).collect()}
    for held, (n, r2) in got.items():
        model = trees.fit(estimator, folds.where(F.col("fold") != held))
        row = evaluate.metrics(model.transform(folds.where(F.col("fold") == held)), "y", "pred").first()
        # Spark ML draws its samples by partition, so only the order of size is the same.
        assert row["n"] == n and abs(row["r2"] - r2) < 0.05
    assert sorted(got) == [0, 1, 2]


@pytest.mark.parametrize("tolerance", [1e-3, 1e-6])
def test_binned_density(spark, tolerance):
    df = spark.range(4000).selectExpr("case when id % 5 = 0 then 3.0 when id % 90 = 1 then null else randn(3) + (id % 3) * 4 end as `a b`").cache()
    exact = {r["step"]: r for r in shape.kde(df, "a b", 300, exact=True).collect()}
    near = {r["step"]: r for r in shape.kde(df, "a b", 300, tolerance=tolerance).collect()}
    peak = 1 / (df.select(F.count("a b")).first()[0] ** -0.2 * np.sqrt(2 * np.pi))
    assert sorted(near) == sorted(exact) == list(range(300))
    assert max(abs(near[i]["density"] - exact[i]["density"]) for i in exact) <= tolerance * peak
    assert all(abs(near[i]["x"] - exact[i]["x"]) < 1e-12 for i in exact)
    values = np.array([r[0] for r in df.dropna().collect()])
    z = (values - values.mean()) / values.std(ddof=1)
    h = len(z) ** -0.2
    want = np.exp(-0.5 * ((exact[150]["x"] - z) / h) ** 2).sum() / (len(z) * h * np.sqrt(2 * np.pi))
    assert abs(exact[150]["density"] - want) < 1e-9
    with pytest.raises(ValueError):
        shape.kde(spark.range(5).selectExpr("1.0 as a"), "a")


def test_mass_is_kept(spark):
    cells = shape.binned(spark.range(1000).selectExpr("cast(id as double) / 7 as z"), "z", 0.0, 0.3).collect()
    assert abs(sum(r["w"] for r in cells) - 1000) < 1e-6
    assert abs(sum(r["w"] * r["z"] for r in cells) - sum(i / 7 for i in range(1000))) < 1e-6


@pytest.mark.parametrize("algorithm", ["ridge", "forest", "boosting"])
def test_saved_models_score_alike(spark, vectors, folder, algorithm):
    store = runs.RunStore(spark, folder)
    if algorithm == "ridge":
        model = linear.fit_linear(vectors, ["b", "a"], "y", 1.0)
        want = vectors.withColumn("pred", model.predict())
    else:
        model = trees.fit(trees.forest("y", trees=4, depth=4) if algorithm == "forest" else trees.boosting("y", rounds=4), vectors)
        want = model.transform(vectors)
    path, params = workflow.save_model(store, model)
    saved = store.save_analysis("me", model_type=algorithm, target_col="y", model_params=params, model_path=path)
    features = ["b", "a"] if algorithm == "ridge" else ["a", "b", "c"]
    got = workflow.predict_saved(runs.RunStore(spark, folder), saved, vectors.drop("features"), features)
    assert {r["id"]: round(r["pred"], 9) for r in got.collect()} == {r["id"]: round(r["pred"], 9) for r in want.collect()}
    with pytest.raises(KeyError):
        store.analysis("none")


@pytest.mark.parametrize("make", [trees.forest, trees.boosting])
def test_no_task_of_a_fit_holds_too_many_points(spark, monkeypatch, make):
    """One partition far larger than the others, which are as many as the cores."""
    rows = spark.range(0, 700_000, 1, 1).union(spark.range(0, 80, 1, 8)).selectExpr("cast(id as double) as a", "cast(id as double) as y")
    estimator = make("y")
    monkeypatch.setattr(type(estimator), "fit", lambda self, kept: kept.groupBy(F.spark_partition_id()).count().collect())
    sizes = [r["count"] for r in trees.fit(estimator, trees.assemble(rows, ["a"]))]
    assert sum(sizes) == 700_080 and max(sizes) < 150_000


@pytest.mark.parametrize("parts", [1, 16])
def test_partitions_of_a_fit_grow_with_the_rows(spark, monkeypatch, parts):
    """Whole rows reach every fold, in partitions of bounded points."""
    monkeypatch.setattr(trees, "PART_BYTES", 20_000, raising=False)
    rows = trees.assemble(spark.range(0, 9000, 1, parts).selectExpr("id", "cast(id % 97 as double) as a", "cast(id % 31 as double) as y"), ["a"])
    estimator, seen = trees.forest("y", trees=2, depth=2), []
    whole = type(estimator).fit

    def watched(self, kept):
        seen.append([r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()])
        return whole(self, kept)

    monkeypatch.setattr(type(estimator), "fit", watched)
    trees.fit(estimator, rows)
    scores = trees.cross_validate(evaluate.kfold(rows, "id", 3), "y", "fold", estimator).collect()
    assert [(r["fold"], r["n"]) for r in scores] == [(0, 3000), (1, 3000), (2, 3000)]
    assert sorted(map(sum, seen)) == [6000, 6000, 6000, 9000]
    assert max(map(max, seen)) <= 20_000 // 140 + parts


def test_few_rows_stay_where_they_are(spark):
    """Draws of a forest depend on the partitions; small inputs keep theirs."""
    rows = trees.assemble(spark.range(0, 900, 1, 11).selectExpr("cast(id as double) as a", "cast(id as double) as y"), ["a"])
    assert trees.spread(rows, trees.forest("y")) is rows
    assert trees.spread(rows.limit(0), trees.forest("y")).count() == 0
    bare = rows.withColumn("features", F.col("features").alias("features", metadata={}))
    assert trees.feature_count(bare, "features") == trees.feature_count(rows, "features") == 1
