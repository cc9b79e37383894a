"""Encoding, regression, diagnostics, shapes and scenarios against closed forms and hand-made cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabcast.functions import values
from tabcast.operators import assoc, comoment, diagnose, encode, evaluate, linear, profile, scenario, shape, trees
from tabcast.operators.encode import Preprocessor
from tabcast.plans import workflow
from tabcast.sources import runs


@pytest.fixture(scope="module")
def known(spark):
    """y = 3 + 2 x1 - 0.5 x2 + e, with x3 close to x1; 200 rows without randomness."""
    rows = []
    for i in range(200):
        x1, x2 = float((i * 37) % 101), float((i * 53) % 89)
        e = ((i * 7919) % 1000) / 100 - 5
        rows.append((i, x1, x2, 0.95 * x1 + ((i * 31) % 17) / 4, 3 + 2 * x1 - 0.5 * x2 + e))
    return spark.createDataFrame(rows, "id bigint, x1 double, x2 double, x3 double, y double").cache()


def as_numpy(df, *columns):
    frame = df.select(*columns).toPandas()
    return [frame[c].to_numpy(float) for c in columns]


# Encoding

def test_codes_for_seen_unseen_and_missing(spark):
    train = spark.createDataFrame(
        [(0, "2024-01-01", "oui", "b", "10", 1.0, 5.0), (1, "2024-03-05", "non", "a", "2", None, 6.0),
         (2, None, "oui", None, "2", 3.0, 7.0), (3, "2024-02-29", None, "a", "10", 8.0, 8.0)],
        "id bigint, d string, b string, cat string, ord string, x double, y double")
    types = {"d": "date", "b": "binary", "cat": "categorical", "ord": "ordinal", "x": "continuous", "y": "continuous", "id": "identifier"}
    prep = Preprocessor(types, key="id").fit(train, "y")
    rows = {r["z_b"]: r for r in prep._encode(train, ("id",)).collect()}
    got = sorted(tuple(r) for r in prep._encode(train, ("id",)).collect())
    # id, date parts, binary by first appearance, labels and text numbers in text order, median 3
    assert got == [
        (0, 2024, 1, 0, 1, 0, 2, 0, 1.0), (1, 2024, 3, 1, 65, 1, 1, 1, 3.0),
        (2, 0, 0, 0, 0, 0, 0, 1, 3.0), (3, 2024, 2, 3, 60, 2, 1, 0, 8.0)]
    assert rows
    new = spark.createDataFrame(
        [(9, "not a date", "non", "zzz", "x", "oops", 0.0)],
        "id bigint, d string, b string, cat string, ord string, x string, y double")
    assert tuple(prep._encode(new, ("id",)).first()) == (9, 0, 0, 0, 0, 1, -1, -1, 3.0)
    scaled = prep.transform(train).toPandas()
    assert np.allclose(scaled.mean(), 0) and np.allclose(scaled.std(ddof=0), 1)
    with pytest.raises(ValueError):
        Preprocessor(types).fit(train, "y")


def test_given_label_order_and_constant_column(spark):
    train = spark.createDataFrame([(0, "low", 4.0, 1.0), (1, "high", 4.0, 2.0), (2, "medium", 4.0, 3.0)], "id int, s string, c double, y double")
    prep = Preprocessor({"s": "ordinal", "c": "continuous"}, "id", {"s": ["low", "medium", "high"]}).fit(train, "y")
    assert [r["s"] for r in prep.encode(train).collect()] == [0.0, 2.0, 1.0]
    assert {r["z_c"] for r in prep.transform(train).collect()} == {0.0}


def test_many_labels_take_the_range_path(spark, monkeypatch):
    from tabcast.operators import order

    df = spark.range(400).selectExpr("id", "concat('L', lpad(cast(id % 120 as string), 4, '0')) as c", "cast(id as double) as y")
    monkeypatch.setattr(order, "BROADCAST_ROWS", 30)
    prep = Preprocessor({"c": "categorical", "y": "continuous"}, "id").fit(df, "y")
    got = {r["id"]: r["z_c"] for r in prep._encode(df, ("id",)).collect()}
    assert got == {i: float(i % 120) for i in range(400)}


def test_years_and_dates(spark):
    df = spark.createDataFrame([(2021, "05/02/2024"), (3, "2024-02-05 10:00:00"), (None, "20240205")], "y int, t string")
    got = df.select(
        values.as_timestamp(F.col("y"), df.schema["y"].dataType).cast("string").alias("y"),
        F.date_format(values.parse_date(F.col("t")), "yyyy-MM-dd").alias("t")).collect()
    assert [r["y"] for r in got] == ["2021-01-01 00:00:00", None, None]
    assert {r["t"] for r in got} == {"2024-02-05"}


# Regression

def test_ols_against_numpy_and_spark_ml(known, spark):
    terms, whole = linear.ols(known, "y", ["x1", "x2", "x3"])
    x = np.column_stack([np.ones(200), *as_numpy(known, "x1", "x2", "x3")])
    (y,) = as_numpy(known, "y")
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    error = y - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (error @ error) / 196)
    got = terms.toPandas()
    assert np.allclose(got["coef"], beta) and np.allclose(got["std_error"], se)
    model = LinearRegression(labelCol="y", solver="normal").fit(
        VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(known))
    p = model.summary.pValues
    assert np.allclose(got["p"], [p[-1], *p[:-1]], atol=1e-9)
    row = whole.first()
    assert math.isclose(row["r2"], model.summary.r2, rel_tol=1e-9)
    assert math.isclose(row["r2_adjusted"], model.summary.r2adj, rel_tol=1e-9)
    loglik = -100 * (math.log(2 * math.pi * (error @ error) / 200) + 1)
    assert math.isclose(row["aic"], -2 * loglik + 8, rel_tol=1e-9) and row["f_p"] < 1e-12
    assert {r["tier"] for r in linear.tiers(terms).collect()} <= {"p<0.01", "p<0.05", "p<0.10", "p>=0.10"}
    with pytest.raises(ValueError):
        linear.ols(known, "y", ["x1", "y"])


def test_p_values_from_tables():
    assert math.isclose(linear.t_two_sided(2.228, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(linear.t_two_sided(1.96, 1e7), 0.05, abs_tol=1e-4)
    assert math.isclose(linear.f_tail(3.098, 3, 20), 0.05, abs_tol=1e-4)


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_ridge_closed_form_and_wide_solver(known, alpha):
    fit = linear.fit_linear(known, ["x1", "x2"], "y", alpha)
    a, b, y = as_numpy(known, "x1", "x2", "y")
    x = np.column_stack([a - a.mean(), b - b.mean()])
    want = np.linalg.solve(x.T @ x + alpha * np.eye(2), x.T @ (y - y.mean()))
    assert np.allclose(fit.coef, want)
    wide = linear._fit_wide(known, ["x1", "x2"], "y", alpha)
    assert np.allclose(wide.coef, want, rtol=1e-6) and math.isclose(wide.intercept, fit.intercept, rel_tol=1e-6)


def test_collinear_and_constant_features(known):
    df = known.withColumns({"twice": F.col("x1") * 2, "flat": F.lit(3.0)})
    fit = linear.fit_linear(df, ["x1", "twice", "flat"], "y")
    plain = linear.fit_linear(known, ["x1"], "y")
    assert math.isclose(fit.coef[0] + 2 * fit.coef[1], plain.coef[0], rel_tol=1e-9) and fit.coef[2] == 0


def test_cross_validation_equals_refits(known):
    rows = evaluate.kfold(known, "id", 4)
    got = {r["fold"]: r["r2"] for r in linear.cross_validate(rows, ["x1", "x2"], "y", "fold", 1.0).collect()}
    for fold in range(4):
        fit = linear.fit_linear(rows.where(F.col("fold") != fold), ["x1", "x2"], "y", 1.0)
        held = rows.where(F.col("fold") == fold).withColumn("pred", fit.predict())
        assert math.isclose(got[fold], evaluate.metrics(held, "y", "pred").first()["r2"], rel_tol=1e-9)
    assert evaluate.cv_summary(linear.cross_validate(rows, ["x1", "x2"], "y", "fold")).first()["stable"]


def test_matrix_sums_equal_built_ins(known, monkeypatch):
    df = known.withColumns({"x2": F.when(F.col("id") % 5 != 0, F.col("x2")), "flat": F.lit(0.1)})
    columns = ["x1", "x2", "x3", "y", "flat"]
    plain = {(r["c1"], r["c2"]): (r["n"], r["r"]) for r in assoc.raw_pairs(df, columns).collect()}
    folds = evaluate.kfold(df, "id", 3)
    by_fold = linear.moments(folds, ["x1", "x2"], "y", "fold")
    monkeypatch.setattr(assoc, "BUILT_IN_COLUMNS", 2)
    monkeypatch.setattr(linear, "BUILT_IN_COLUMNS", 2)
    monkeypatch.setattr(comoment, "MAX_COLUMNS", 4)
    wide = {(r["c1"], r["c2"]): (r["n"], r["r"]) for r in assoc.raw_pairs(df, columns).collect()}
    assert set(wide) == set(plain)
    for pair, (n, r) in plain.items():
        assert wide[pair][0] == n
        assert (wide[pair][1] is None) == (r is None) and (r is None or abs(wide[pair][1] - r) < 1e-9)
    for fold, m in linear.moments(folds, ["x1", "x2"], "y", "fold").items():
        assert m.n == by_fold[fold].n
        assert np.allclose(m.mean, by_fold[fold].mean) and np.allclose(m.co, by_fold[fold].co)


def test_pairs_bands_and_ties(spark, known):
    pairs = {(r["c1"], r["c2"]): r for r in assoc.pearson_pairs(known, ["x1", "x2", "x3", "y"]).collect()}
    assert pairs["x1", "x3"]["strength"] == "very_strong" and pairs["x1", "y"]["direction"] == "positive"
    assert {(r["c1"], r["c2"]) for r in assoc.collinear_pairs(known, ["x1", "x2", "x3"], 0.7).collect()} == {("x1", "x3")}
    ties = spark.createDataFrame([(1, 1.0, 4.0), (2, 1.0, None), (3, None, 2.0), (4, 2.0, 1.0), (5, 2.0, 3.0)], "id int, a double, b double")
    study = assoc.study_pair(ties, "a", "b").first()
    full = pd.DataFrame([(1.0, 4.0), (2.0, 1.0), (2.0, 3.0)])
    assert study["n"] == 3 and math.isclose(study["r"], full[0].corr(full[1]))
    assert math.isclose(study["rho"], full[0].rank().corr(full[1].rank()))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert assoc.study_pair(flat, "a", "b").first()["p"] is None
    assert {r["value"]: r["avg_rank"] for r in assoc.average_ranks(ties, "a").collect()} == {1.0: 1.5, 2.0: 3.5}
    assert [(r["column"], r["mode"]) for r in profile.modes(ties, ["a"]).collect()] == [("a", "1.0")]


# Trees

def test_forest_boosting_importance_and_interval(known, spark):
    rows = trees.assemble(known, ["x1", "x2"])
    model = trees.fit(trees.forest("y", trees=15, depth=6), rows)
    scored = trees.tree_interval(model, rows)
    assert evaluate.metrics(scored, "y", "pred").first()["r2"] > 0.95
    by_tree = trees.tree_predictions(model, rows).select("id", "by_tree").toPandas().set_index("id")["by_tree"]
    one = model.trees[3].setPredictionCol("one").transform(rows.select("id", "features")).select("id", "one").toPandas()
    assert all(math.isclose(by_tree[i][3], v) for i, v in zip(one["id"], one["one"]))
    ends = scored.select("id", "pred", "ci_low", "ci_high").toPandas()
    assert np.allclose(ends["ci_low"], [np.percentile(by_tree[i], 5) for i in ends["id"]])
    assert np.allclose(ends["ci_high"], [np.percentile(by_tree[i], 95) for i in ends["id"]])
    assert np.allclose(ends["pred"], [np.mean(by_tree[i]) for i in ends["id"]])
    shares = trees.importances(spark, ["x1", "x2"], model.featureImportances.toArray())
    top = trees.top_importance(shares).orderBy(F.desc("importance")).collect()
    assert top[0]["feature"] == "x1" and top[0]["above_mean"] and not top[1]["above_mean"]
    boosted = trees.fit(trees.boosting("y", rounds=8), rows)
    assert evaluate.metrics(boosted.transform(rows), "y", "pred").first()["r2"] > 0.5
    scores = trees.cross_validate(evaluate.kfold(rows, "id", 3), "y", "fold", trees.forest("y", trees=5, depth=5))
    assert scores.count() == 3 and scores.agg(F.min("r2")).first()[0] > 0.8


# Diagnostics

def test_residual_and_scatter_reports(spark):
    def report(pairs):
        df = spark.createDataFrame([(i, float(y), float(p)) for i, (y, p) in enumerate(pairs)], "id int, y double, p double")
        return diagnose.residual_report(df, "y", "p", "id").first(), diagnose.scatter_report(df, "y", "p").first()

    fair, near = report([(float(i), i + (1 if i % 2 else -1)) for i in range(101)])
    assert (fair["bias"], fair["spread"], fair["n_outliers"]) == ("none", "equal", 0)
    assert (near["fit"], near["bias_side"]) == ("close", "none")
    over, _ = report([(float(i), i + 5.0 + i % 3) for i in range(50)])
    assert over["bias"] == "over"
    fan, _ = report([(i + (i / 10 if i % 2 else -i / 10), float(i)) for i in range(101)])
    assert fan["spread"] == "unequal"
    odd, _ = report([(float(i) + (60 if i == 50 else (i % 2 - 0.5)), float(i)) for i in range(100)])
    assert odd["n_outliers"] == 1 and odd["form"] == "near_normal"
    flat, level = report([(4.0, 4.0 + i % 2) for i in range(9)])
    assert level["median_percent"] == 0.0 and flat["n"] == 9
    df = spark.createDataFrame([(4.0, 4.0), (4.0, 5.0)], "y double, p double")
    assert evaluate.metrics(df, "y", "p").first()["r2"] is None


# Shapes

def test_shapes(spark):
    values_ = [float((i * 7919) % 997) for i in range(500)] + [5000.0, None]
    df = spark.createDataFrame([(v, v if v is None else v * 2 + (v % 7)) for v in values_], "x double, y double")
    x = np.array([v for v in values_ if v is not None])
    hist = shape.histogram(df, "x", 25).orderBy("bin").toPandas()
    assert hist["n"].sum() == 501 and hist["n"].tolist() == np.histogram(x, 25)[0].tolist()
    assert math.isclose((hist["density"] * (hist["high"] - hist["low"])).sum(), 1)
    flat = shape.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 4)
    assert flat.agg(F.sum("n")).first()[0] == 4
    box = shape.boxplot(df, ["x"], standardise=False).first()
    assert math.isclose(box["q50"], np.median(x)) and box["n_outliers"] == 1 and box["whisker_high"] < 1000
    z = (x - x.mean()) / x.std(ddof=1)
    got = shape.kde(df, "x", 60).orderBy("step").toPandas()
    at, h = got["x"].to_numpy(), len(x) ** -0.2
    want = np.exp(-0.5 * ((at[:, None] - z) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose(got["density"], want)
    assert shape.hexbin(df, "x", "y").agg(F.sum("n")).first()[0] == 501
    curve = shape.normal_curve(df, "x", 200).orderBy("step").toPandas()
    assert len(curve) == 200 and math.isclose(curve["x"].iloc[-1], 5000)


# Scenarios and workflows

def test_what_if_sweep_and_projection(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "u", None), ("a", 3.0, "v", True), ("b", 10.0, "w", True), (None, 4.0, "w", False), ("a", 2.0, "v", True)],
        "g string, x double, s string, f boolean")
    base = {r["g"]: tuple(r)[1:] for r in scenario.baseline(df, ["x", "s", "f"], ["g"]).collect()}
    assert base == {"a": (3, 2.0, "v", True), "b": (1, 10.0, "w", True), None: (1, 4.0, "w", False)}
    whole = scenario.baseline(df, ["x", "s"])
    assert tuple(whole.first()) == (5, 4.0, "v")
    asked = spark.createDataFrame([(1, 9.0, "a"), (2, None, "b")], "case int, x double, g string")
    got = {r["case"]: (r["x"], r["s"]) for r in scenario.what_if(whole, asked.drop("g")).collect()}
    assert got == {1: (9.0, "v"), 2: (4.0, "v")}
    by_group = scenario.what_if(scenario.baseline(df, ["x", "s"], ["g"]), asked, "g")
    assert {r["case"]: (r["x"], r["s"]) for r in by_group.collect()} == {1: (9.0, "v"), 2: (10.0, "w")}
    steps = scenario.sweep(whole, "x", 0, 10, 5).orderBy("step").collect()
    assert [r["x"] for r in steps] == [0.0, 2.5, 5.0, 7.5, 10.0]
    start = F.to_date(F.lit("2024-01-31"))
    month = [r["at"] for r in scenario.future_dates(whole, start, 2, "month").orderBy("step").collect()]
    assert month == ["2024-03-01", "2024-03-31"]
    true_month = [r["at"] for r in scenario.future_dates(whole, start, 2, "month", calendar=True).orderBy("step").collect()]
    assert true_month == ["2024-02-29", "2024-03-31"]
    dated = spark.createDataFrame([(1.0, "2020-01-01", 1999, 5)], "x double, d string, annee int, mois int")
    rows = scenario.project(scenario.baseline(dated, dated.columns), {"d": "date"}, start, 1, "year").first()
    assert (str(rows["d"])[:10], rows["annee"], rows["mois"]) == ("2025-01-30", 2025, 1)


@pytest.mark.parametrize("algorithm", ["linear", "ridge", "auto"])
def test_train_and_predict(spark, known, folder, algorithm):
    df = known.withColumns({
        "day": F.date_add(F.to_date(F.lit("2024-01-01")), F.col("id").cast("int")),
        "kind": F.when(F.col("id") % 3 == 0, "red").otherwise("blue"),
        "y": F.when(F.col("id") != 7, F.col("y")),
    })
    types = {"id": "identifier", "x1": "continuous", "x2": "continuous", "x3": "continuous", "y": "continuous", "day": "date", "kind": "categorical"}
    store = runs.RunStore(spark, f"{folder}/runs")
    got = workflow.train(
        df, "y", "id", types, algorithm, folds=3, store=store, owner="me", trees_count=20, depth=6,
        fit_scope="all" if algorithm == "ridge" else "train")
    assert got.algorithm == {"auto": "forest"}.get(algorithm, algorithm)
    assert got.metrics["r2"] > 0.9 and got.cv["cv_r2_mean"] > 0.8
    assert got.n_train + got.n_test == 199 and got.dropped == 1
    saved = runs.best_model(store.analyses(), "me", "y").first()
    assert saved["analysis_id"] == got.analysis_id and math.isclose(saved["r2"], got.metrics["r2"])
    sweep = workflow.predict_sweep(got, df, "x1", steps=5)
    ends = scenario.sweep_trend(sweep, "x").first()
    assert ends["trend"] == "rising"
    future = workflow.predict_future(got, df, "day", 3, "week", by=["kind"])
    assert {(r["kind"], r["step"]): r["at"] for r in future.collect()}["blue", 1] == "2024-07-25"
    asked = spark.createDataFrame([(1, 100.0), (2, 0.0)], "case int, x1 double")
    answer = {r["case"]: r["pred"] for r in workflow.predict_what_if(got, df, asked, ("case",)).collect()}
    assert answer[1] > answer[2]
    store.save_predictions(sweep, "me", got.analysis_id, "sweep", ["x"])
    log = runs.prediction_log(store.predictions(), store.analyses(), "me")
    assert log.count() == 5 and log.first()["target_col"] == "y"


def test_binary_text_target(spark):
    df = spark.createDataFrame([(i, float(i), " Oui" if i > 50 else "non") for i in range(100)], "id int, x double, ok string")
    coded = {(r["id"] > 50): r["ok"] for r in workflow.as_target(df, "ok").collect()}
    assert coded == {True: 1.0, False: 0.0}


def test_run_history(spark, folder):
    store = runs.RunStore(spark, f"{folder}/runs")
    assert not store.has("analyses")
    for i in range(4):
        store.save_analysis("a", model_type="ridge" if i else "forest", target_col="t", r2=[0.5, 0.9, 0.9, None][i])
    store.save_analysis("b", model_type="linear", target_col="t", r2=0.1)
    with pytest.raises(ValueError):
        store.save_analysis("a", colour="red")
    assert runs.target_history(store.analyses(), "a", "t").count() == 4
    assert runs.choose_algorithm(runs.target_history(store.analyses(), "a", "t")) == "ridge"
    assert runs.choose_algorithm(runs.target_history(store.analyses(), "b", "t")) == "forest"
    assert runs.choose_algorithm(runs.target_history(store.analyses(), "b", "t"), "best") == "linear"
    summary = {r["owner"]: r for r in runs.target_summary(store.analyses()).collect()}
    assert summary["a"]["n_runs"] == 4 and summary["a"]["best_r2"] == 0.9 and summary["a"]["recommended"] == "ridge"
    assert "—" in {r["r2_text"] for r in runs.analysis_log(store.analyses(), "a").collect()}
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2], None) for i in range(30)], "id int, x double, s string, e string")
    for _ in range(3):
        found = workflow.profile_dataset(df, store, "a", "file")
    assert runs.recent_datasets(store.datasets(), "a", 2).count() == 2
    assert store.restore_types(found.dataset_id) == found.types
    row = store.datasets().where(F.col("dataset_id") == found.dataset_id).first()
    assert row["column_stats"]["x"]["mean"] == 14.5 and row["column_stats"]["s"]["top3"] == ["a", "b"]
    assert row["correlation"][0]["r"] == 1.0 and row["n_rows"] == 30
