"""Queries over the run tables.

The given tables stand in for a history: orders as analyses and datasets, line
items as predictions.
"""

from pyspark.sql import functions as F

from tabcast.operators import assoc, evaluate, linear, profile, scenario, typing
from tabcast.plans import workflow
from tabcast.plans.profile_queries import TYPED_TABLES, top3_sql, types_sql
from tabcast.plans.registry import query, table
from tabcast.sources import runs, tables

ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_OTHERS = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


def stored_dataset(spark, d):
    """The profile of the orders, saved as one dataset row and read back."""
    orders = table(spark, d, "orders")
    store = runs.RunStore(spark, tables.work_folder(spark))
    types = typing.type_map(typing.decide_types(orders))
    dataset_id = store.save_dataset(
        "owner-1", "orders", orders.count(), types, profile.profile_numeric(orders, ORDER_NUMBERS),
        profile.profile_categorical(orders, ORDER_OTHERS), assoc.raw_pairs(orders, ORDER_NUMBERS))
    return store, dataset_id


def number_stats_sql(c):
    return f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS median,
      count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS nulls, NULL AS top1 FROM orders"""


def other_stats_sql(c, shown):
    return f"""SELECT '{c}', NULL, NULL, count(DISTINCT {c}), count(*) - count({c}),
      (SELECT v FROM (SELECT {shown} AS v, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, v LIMIT 1) FROM orders"""


STATS_SQL = "\nUNION ALL\n".join(
    [number_stats_sql(c) for c in ORDER_NUMBERS]
    + [other_stats_sql(c, "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')" if c == "o_orderdate" else c) for c in ORDER_OTHERS])


@query("run_datasets", f"SELECT *, (SELECT count(*) FROM orders) AS n_rows FROM ({STATS_SQL})")
def run_datasets(spark, d):
    store, _ = stored_dataset(spark, d)
    stats = store.datasets().select("n_rows", F.explode("column_stats").alias("column", "s"))
    return stats.select(
        "column", "n_rows", "s.mean", "s.median", "s.n_unique", "s.nulls", F.get("s.top3", F.lit(0)).alias("top1"))


@query("restore_types", f"""SELECT "column", "type" FROM ({types_sql('orders', TYPED_TABLES['orders'])})""")
def restore_types(spark, d):
    store, _ = stored_dataset(spark, d)
    exported = runs.profile_json(store.datasets())
    return runs.types_long(runs.types_from_json(exported)).select("column", "type")


@query("profile_json", STATS_SQL)
def profile_json(spark, d):
    """The column statistics as exported JSON, read again by any JSON reader."""
    store, _ = stored_dataset(spark, d)
    exported = runs.profile_json(store.datasets())
    kind = "map<string,struct<mean:double,median:double,n_unique:bigint,nulls:bigint,top3:array<string>>>"
    stats = exported.select(F.explode(F.from_json("column_stats", kind)).alias("column", "s"))
    return stats.select("column", "s.mean", "s.median", "s.n_unique", "s.nulls", F.get("s.top3", F.lit(0)).alias("top1"))


@query("run_predictions", """WITH line AS (SELECT regr_slope(c_acctbal, c_nationkey) AS slope, regr_intercept(c_acctbal, c_nationkey) AS icept FROM customer),
  miss AS (SELECT sqrt(avg(pow(c_acctbal - icept - slope * c_nationkey, 2))) AS rmse FROM customer, line)
  SELECT CAST(c_custkey AS INTEGER) AS step, CAST(c_nationkey AS VARCHAR) AS nation, round(icept + slope * c_nationkey, 4) AS predicted,
    round(icept + slope * c_nationkey - 1.96 * rmse, 4) AS ci_low, round(icept + slope * c_nationkey + 1.96 * rmse, 4) AS ci_high, 'by nation' AS label
  FROM customer, line, miss""")
def run_predictions(spark, d):
    customer = table(spark, d, "customer")
    fit = linear.fit_linear(customer, ["c_nationkey"], "c_acctbal")
    error = (linear.squared_error(fit, fit.moments) / fit.moments.n) ** 0.5
    rows = customer.select(F.col("c_custkey").alias("step"), "c_nationkey", fit.predict().alias("pred"))
    store = runs.RunStore(spark, tables.work_folder(spark))
    store.save_predictions(scenario.rmse_interval(rows, error), "owner-1", "analysis-1", "by nation", ["c_nationkey"])
    return store.predictions().select(
        "step", F.col("input_values")["c_nationkey"].alias("nation"), F.round("predicted", 4).alias("predicted"),
        F.round("ci_low", 4).alias("ci_low"), F.round("ci_high", 4).alias("ci_high"), "label")


def as_datasets(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("dataset_id"), F.col("o_orderpriority").alias("owner"),
        F.col("o_orderstatus").alias("filename"), F.col("o_orderdate").alias("uploaded_at"))


def as_analyses(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("owner"),
        F.col("o_orderpriority").alias("target_col"), F.col("o_orderstatus").alias("model_type"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("r2"), F.col("o_orderdate").alias("created_at"))


ANALYSES = """analyses AS (SELECT o_orderkey AS analysis_id, o_custkey AS owner, o_orderpriority AS target_col, o_orderstatus AS model_type,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS r2, o_orderdate AS created_at FROM orders)"""


def as_predictions(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("prediction_id"),
        (F.col("l_orderkey") + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)).alias("analysis_id"),
        F.col("l_returnflag").alias("owner"), F.col("l_extendedprice").alias("predicted"), F.col("l_shipdate").alias("created_at"))


@query("recent_datasets", """SELECT owner, dataset_id, filename, strftime(uploaded_at, '%Y-%m-%d') AS uploaded_at, CAST(place AS INTEGER) AS place FROM (
  SELECT o_orderpriority AS owner, o_orderkey AS dataset_id, o_orderstatus AS filename, o_orderdate AS uploaded_at,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 20""")
def recent_datasets(spark, d):
    found = runs.recent_datasets(as_datasets(spark, d))
    return found.withColumn("uploaded_at", F.date_format("uploaded_at", "yyyy-MM-dd"))


@query("best_model", f"""WITH {ANALYSES} SELECT owner, target_col, analysis_id, model_type, r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY owner, target_col ORDER BY r2 DESC NULLS LAST, analysis_id) AS p FROM analyses) WHERE p = 1""")
def best_model(spark, d):
    return runs.best_model(as_analyses(spark, d)).drop("created_at")


@query("analysis_log", f"""WITH {ANALYSES} SELECT owner, target_col, analysis_id, model_type, strftime(created_at, '%Y-%m-%d') AS created_at,
  coalesce(format('{{:.4f}}', r2), '—') AS r2_text FROM analyses""")
def analysis_log(spark, d):
    log = runs.analysis_log(as_analyses(spark, d))
    return log.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd")).drop("r2")


@query("prediction_log", f"""WITH {ANALYSES}, predictions AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS prediction_id,
    l_orderkey + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS analysis_id, l_returnflag AS owner, l_extendedprice AS predicted, l_shipdate AS created_at FROM lineitem)
  SELECT prediction_id, analysis_id, owner, predicted, model_type, target_col, CAST(place AS INTEGER) AS place FROM (
    SELECT p.*, a.model_type, a.target_col, row_number() OVER (PARTITION BY p.owner ORDER BY p.created_at DESC, prediction_id) AS place
    FROM predictions p JOIN analyses a ON p.analysis_id = a.analysis_id) WHERE place <= 50""")
def prediction_log(spark, d):
    return runs.prediction_log(as_predictions(spark, d), as_analyses(spark, d)).drop("created_at")


@query("target_history", f"""WITH {ANALYSES} SELECT owner, target_col, analysis_id, model_type, r2, strftime(created_at, '%Y-%m-%d') AS created_at FROM analyses""")
def target_history(spark, d):
    found = runs.target_history(as_analyses(spark, d))
    return found.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


SUMMARY = f"""WITH {ANALYSES} SELECT owner, target_col, count(*) AS n_runs, max(coalesce(r2, 0.0)) AS best_r2,
  first(model_type ORDER BY coalesce(r2, 0.0) DESC, analysis_id) AS best_model,
  CASE WHEN count(*) >= 3 THEN 'ridge' ELSE 'forest' END AS recommended FROM analyses GROUP BY 1, 2"""


@query("target_summary", SUMMARY)
def target_summary(spark, d):
    return runs.target_summary(as_analyses(spark, d))


@query("auto_choice", f"SELECT recommended, count(*) AS n_targets FROM ({SUMMARY}) GROUP BY 1")
def auto_choice(spark, d):
    return runs.target_summary(as_analyses(spark, d)).groupBy("recommended").agg(F.count(F.lit(1)).alias("n_targets"))


@query("saved_analysis", """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b,
    round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem)
  SELECT l_orderkey, l_linenumber, 'linear' AS model_type, 'l_quantity' AS feature, r2, round(a * l_quantity + b, 4) AS pred FROM lineitem, m""")
def saved_analysis(spark, d):
    """A model trained and saved as an analysis, found by its id in a fresh store, and used again."""
    lineitem = table(spark, d, "lineitem")
    root = tables.work_folder(spark)
    fitted = linear.fit_linear(lineitem, ["l_quantity"], "l_extendedprice")
    scores = evaluate.metrics(lineitem.withColumn("pred", fitted.predict()), "l_extendedprice", "pred").first()
    store = runs.RunStore(spark, root)
    path, params = workflow.save_model(store, fitted)
    analysis_id = store.save_analysis(
        "owner-1", model_type="linear", target_col="l_extendedprice", feature_cols=["l_quantity"], r2=scores["r2"],
        model_params=params, model_path=path)
    again = runs.RunStore(spark, root)
    scored = workflow.predict_saved(again, analysis_id, lineitem, ["l_quantity"])
    saved = again.analyses().where(F.col("analysis_id") == analysis_id)
    facts = saved.select("model_type", F.get("feature_cols", F.lit(0)).alias("feature"), F.round("r2", 6).alias("r2"))
    # One row: the analysis.
    row = facts.first()
    return scored.select(
        "l_orderkey", "l_linenumber", *[F.lit(row[c]).alias(c) for c in facts.columns], F.round("pred", 4).alias("pred"))
