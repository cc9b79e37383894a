"""Queries over encoding, regression, validation, diagnostics and scenarios."""

from pyspark.sql import functions as F

from tabcast.functions import bands
from tabcast.operators import assoc, diagnose, encode, evaluate, linear, scenario, shape, trees, typing
from tabcast.operators.encode import Preprocessor
from tabcast.plans.profile_queries import CHARGED, GAPPY, charged_lineitem, gappy_lineitem, p_sql, union_sql
from tabcast.plans.registry import query, table
from tabcast.sources import tables


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Encoding

CODED = ["o_orderkey", "code"]
STATUS_NOW = "CASE WHEN o_orderpriority = '5-LOW' THEN 'new' ELSE o_orderstatus END"


def changed_orders(spark, d):
    """Orders whose status holds missing values and, in ``status_now``, a label never seen before."""
    orders = table(spark, d, "orders")
    return orders.select(
        "o_orderkey", "o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.expr(STATUS_NOW).alias("status_now"),
    )


@query("label_map", """SELECT label, n, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS code FROM (
  SELECT coalesce(nullif(o_orderstatus, 'P'), '__NA__') AS label, count(*) AS n FROM orders GROUP BY 1)""")
def label_map(spark, d):
    return encode.label_map(changed_orders(spark, d), "status")


@query("encode_binary", """WITH sold AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'oui' WHEN o_orderstatus = 'O' THEN 'non' ELSE '__NA__' END AS label FROM orders),
  codes AS (SELECT label, row_number() OVER (ORDER BY first_key) - 1 AS code FROM (SELECT label, min(o_orderkey) AS first_key FROM sold GROUP BY 1))
  SELECT o_orderkey, CAST(code AS INTEGER) AS code FROM sold JOIN codes USING (label)""")
def encode_binary(spark, d):
    sold = F.when(F.col("o_orderstatus") == "F", "oui").when(F.col("o_orderstatus") == "O", "non")
    rows = table(spark, d, "orders").select("o_orderkey", sold.alias("sold"))
    return encode.apply_codes(rows, "sold", encode.appearance_map(rows, "sold", "o_orderkey"), "code").select(*CODED)


ENCODE_SQL = """WITH codes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (
    SELECT DISTINCT coalesce(nullif(o_orderstatus, 'P'), '__NA__') AS label FROM orders)),
  now AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'new' ELSE o_orderstatus END AS label FROM orders)
  SELECT o_orderkey, CAST(coalesce(code, -1) AS INTEGER) AS code FROM now LEFT JOIN codes USING (label)"""


@query("encode_categorical", ENCODE_SQL)
def encode_categorical(spark, d):
    rows = changed_orders(spark, d)
    return encode.apply_codes(rows, "status_now", encode.label_map(rows, "status"), "code").select(*CODED)


@query("encode_ordinal", """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2
  WHEN '1-URGENT' THEN 3 ELSE -1 END AS INTEGER) AS code FROM orders""")
def encode_ordinal(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    codes = encode.given_order(spark, ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"])
    return encode.apply_codes(rows, "o_orderpriority", codes, "code").select(*CODED)


@query("fill_missing", f"""WITH {GAPPY} SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice,
  coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM gappy)) AS l_discount,
  coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM gappy)) AS l_tax, coalesce(l_returnflag, '__NA__') AS l_returnflag FROM gappy""")
def fill_missing(spark, d):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    return encode.fill_missing(gappy_lineitem(spark, d).select(columns), ["l_discount", "l_tax"], ["l_returnflag"])


@query("scale_features", """SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - a) / b, 6) AS l_quantity,
  round((l_extendedprice - c) / e, 6) AS l_extendedprice
  FROM lineitem, (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_extendedprice) AS c, stddev_pop(l_extendedprice) AS e FROM lineitem)""")
def scale_features(spark, d):
    keep = ("l_orderkey", "l_linenumber", "l_partkey")
    return rounded(
        encode.scale_features(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], keep),
        6, "l_quantity", "l_extendedprice")


ENCODED_ORDERS = """encoded AS (SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey,
    CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS o_orderstatus,
    CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate_year, CAST(month(o_orderdate) AS DOUBLE) AS o_orderdate_month,
    CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS o_orderdate_dayofweek, CAST(dayofyear(o_orderdate) AS DOUBLE) AS o_orderdate_dayofyear,
    CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority FROM orders)"""
ORDER_FEATURES = [
    "o_custkey", "o_orderstatus", "o_orderdate_year", "o_orderdate_month", "o_orderdate_dayofweek", "o_orderdate_dayofyear",
    "o_orderpriority",
]


@query("feature_frame", f"""WITH {ENCODED_ORDERS}, stats AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ORDER_FEATURES)} FROM encoded)
  SELECT o_orderkey, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS z_{c}" for c in ORDER_FEATURES)} FROM encoded, stats""")
def feature_frame(spark, d):
    orders = table(spark, d, "orders")
    prep = Preprocessor(typing.type_map(typing.decide_types(orders)), key="o_orderkey").fit(orders, "o_totalprice")
    return rounded(prep.transform(orders, ("o_orderkey",)), 6, *prep.outputs)


# Splits and folds

@query("split_counts", """SELECT is_test, count(*) AS n FROM (
  SELECT ((o_orderkey % 2147483647) * 48271 + 42) % 2147483647 % 1000 < 200 AS is_test FROM orders) GROUP BY 1""")
def split_counts(spark, d):
    return evaluate.split_counts(table(spark, d, "orders"), "o_orderkey")


FOLDS = """folds AS (SELECT *, CAST((SELECT count(*) FROM range(1, 5) g(i) WHERE place >= i * (n // 5) + least(i, n % 5)) AS INTEGER) AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders))"""


@query("kfold_assign", f"WITH {FOLDS} SELECT o_orderkey, fold FROM folds")
def kfold_assign(spark, d):
    return evaluate.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


# Regression with two features in closed form

TWO = """, m AS (SELECT count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my, var_pop({x1}) AS a, var_pop({x2}) AS b,
    covar_pop({x1}, {x2}) AS c, covar_pop({x1}, {y}) AS d, covar_pop({x2}, {y}) AS e, var_pop({y}) AS v FROM {source}),
  fit AS (SELECT *, (({b}) * d - c * e) / ({a} * ({b}) - c * c) AS b1, ({a} * e - c * d) / ({a} * ({b}) - c * c) AS b2 FROM m),
  line AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM fit)"""


def two_sql(source, x1, x2, y, alpha=0.0):
    """Coefficients b0, b1, b2 of a regression on two features, with a ridge penalty."""
    return TWO.format(source=source, x1=x1, x2=x2, y=y, a=f"(a + {alpha} / n)", b=f"b + {alpha} / n")


TERMS_SQL = """SELECT 'const' AS term, round(b0, {k}) AS coef FROM line UNION ALL SELECT '{x1}', round(b1, {k}) FROM line
  UNION ALL SELECT '{x2}', round(b2, {k}) FROM line"""
X1, X2, Y = "l_extendedprice", "l_discount", "charge"


@query("fit_linear", f"WITH {CHARGED} {two_sql('charged', X1, X2, Y)} {TERMS_SQL.format(x1=X1, x2=X2, k=4)}")
def fit_linear(spark, d):
    fit = linear.fit_linear(charged_lineitem(spark, d), [X1, X2], Y)
    return rounded(linear.coefficients(spark, fit), 4, "coef")


SCALED = f"""{CHARGED}, spread AS (SELECT avg({X1}) AS u1, stddev_pop({X1}) AS s1, avg({X2}) AS u2, stddev_pop({X2}) AS s2 FROM charged),
  scaled AS (SELECT ({X1} - u1) / s1 AS {X1}, ({X2} - u2) / s2 AS {X2}, {Y} FROM charged, spread)"""


@query("fit_ridge", f"WITH {SCALED} {two_sql('scaled', X1, X2, Y, 1.0)} {TERMS_SQL.format(x1=X1, x2=X2, k=4)}")
def fit_ridge(spark, d):
    rows = encode.scale_features(charged_lineitem(spark, d), [X1, X2], (Y,))
    return rounded(linear.coefficients(spark, linear.fit_linear(rows, [X1, X2], Y, alpha=1.0)), 4, "coef")


@query("predict_linear", f"""WITH {CHARGED} {two_sql('charged', X1, X2, Y)}
  SELECT l_orderkey, l_linenumber, l_quantity, round(round(b0, 4) + round(b1, 4) * {X1} + round(b2, 4) * {X2}, 6) AS pred FROM charged, line""")
def predict_linear(spark, d):
    rows = charged_lineitem(spark, d)
    fit = linear.fit_linear(rows, [X1, X2], Y).rounded(4)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", F.round(fit.predict(), 6).alias("pred"))


SCORED = f"{CHARGED} {two_sql('charged', X1, X2, Y)}, scored AS (SELECT *, b0 + b1 * {X1} + b2 * {X2} AS pred FROM charged, line)"
METRICS = """avg((charge - pred) * (charge - pred)) AS mse, avg(abs(charge - pred)) AS mae, var_pop(charge) AS vy,
  max(charge) - min(charge) AS y_range, count(*) AS n"""


def scored_charges(spark, d):
    rows = charged_lineitem(spark, d)
    return rows.withColumn("pred", linear.fit_linear(rows, [X1, X2], Y).predict())


@query("metrics", f"""WITH {SCORED}, found AS (SELECT {METRICS} FROM scored)
  SELECT n, round(1 - mse / vy, 6) AS r2, round(mse, 2) AS mse, round(mae, 4) AS mae, round(sqrt(mse), 4) AS rmse FROM found""")
def metrics(spark, d):
    found = evaluate.metrics(scored_charges(spark, d), Y, "pred")
    return rounded(rounded(rounded(found, 4, "mae", "rmse"), 2, "mse"), 6, "r2")


@query("metrics_banded", f"""WITH {SCORED}, found AS (SELECT {METRICS} FROM scored), g AS (SELECT *, 1 - mse / vy AS r2, mae / y_range * 100 AS share FROM found)
  SELECT n, round(r2, 6) AS r2, round(share, 6) AS mae_percent,
    CASE WHEN r2 >= 0.9 THEN 'excellent' WHEN r2 >= 0.75 THEN 'very_good' WHEN r2 >= 0.6 THEN 'good' WHEN r2 >= 0.4 THEN 'average' ELSE 'insufficient' END AS quality,
    r2 >= 0.95 AS overfit_note, CASE WHEN share < 5 THEN 'very_low' WHEN share < 15 THEN 'acceptable' ELSE 'high' END AS mae_band FROM g""")
def metrics_banded(spark, d):
    found = evaluate.metrics_banded(scored_charges(spark, d), Y, "pred")
    return rounded(found.select("n", "r2", "mae_percent", "quality", "overfit_note", "mae_band"), 6, "r2", "mae_percent")


def key_rows(spark, d):
    """Order prices beside their customer key, with the least-squares line as prediction."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return rows.withColumn("pred", linear.fit_linear(rows, ["x"], "y").predict())


KEY_ROWS = """rows0 AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders),
  line AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept FROM rows0),
  keyed AS (SELECT o_orderkey, x, y, icept + slope * x AS pred, y - (icept + slope * x) AS e FROM rows0, line)"""


@query("cv_linear", f"""WITH {FOLDS}, held AS (SELECT DISTINCT fold AS h FROM folds),
  fits AS (SELECT h, regr_slope(o_totalprice, o_custkey) AS slope, regr_intercept(o_totalprice, o_custkey) AS icept FROM held JOIN folds ON fold <> h GROUP BY h),
  scores AS (SELECT h AS fold, count(*) AS n, 1 - avg(pow(o_totalprice - icept - slope * o_custkey, 2)) / var_pop(o_totalprice) AS r2 FROM fits JOIN folds ON fold = h GROUP BY h)
  SELECT fold, n, round(r2, 6) AS r2, round(avg(r2) OVER (), 6) AS cv_r2_mean, round(stddev_pop(r2) OVER (), 6) AS cv_r2_std,
         stddev_pop(r2) OVER () < 0.05 AS stable FROM scores""")
def cv_linear(spark, d):
    rows = evaluate.kfold(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 5)
    scores = linear.cross_validate(rows, ["o_custkey"], "o_totalprice", "fold")
    whole = evaluate.cv_summary(scores).first()
    return scores.select(
        "fold", "n", F.round("r2", 6).alias("r2"), F.lit(round(whole["cv_r2_mean"], 6)).alias("cv_r2_mean"),
        F.lit(round(whole["cv_r2_std"], 6)).alias("cv_r2_std"), F.lit(whole["stable"]).alias("stable"))


OLS_SOURCE = "lineitem"
O1, O2, OY = "l_quantity", "l_discount", "l_extendedprice"
OLS = f"""{two_sql(OLS_SOURCE, O1, O2, OY).replace(', m AS', 'm AS', 1)},
  res AS (SELECT *, n * (v - b1 * d - b2 * e) AS sse, n * v AS sst, a * b - c * c AS det FROM line),
  var AS (SELECT *, sse / (n - 3) AS s2 FROM res),
  se AS (SELECT *, sqrt(s2 * b / det / n) AS se1, sqrt(s2 * a / det / n) AS se2,
         sqrt(s2 / n * (1 + (m1 * m1 * b - 2 * m1 * m2 * c + m2 * m2 * a) / det)) AS se0 FROM var)"""


@query("ols_two", f"""WITH {OLS}, terms AS (
    SELECT 'const' AS term, b0 AS coef, se0 AS std_error, n FROM se UNION ALL
    SELECT '{O1}', b1, se1, n FROM se UNION ALL SELECT '{O2}', b2, se2, n FROM se),
  tested AS (SELECT *, {p_sql('coef / std_error', '(n - 3)')} AS p FROM terms)
  SELECT term, round(coef, 4) AS coef, round(std_error, 4) AS std_error, round(coef / std_error, 4) AS t,
    CASE WHEN abs(coef / std_error) > 20 THEN 0.0 ELSE round(p, 6) END AS p,
    CASE WHEN abs(coef / std_error) > 20 THEN 1.0 ELSE round(1 - p, 6) END AS e_value,
    CASE WHEN term = 'const' THEN NULL WHEN p < 0.01 THEN 'p<0.01' WHEN p < 0.05 THEN 'p<0.05' WHEN p < 0.1 THEN 'p<0.10' ELSE 'p>=0.10' END AS tier FROM tested""")
def ols_two(spark, d):
    terms, _ = linear.ols(table(spark, d, OLS_SOURCE), OY, [O1, O2])
    return rounded(rounded(terms, 4, "coef", "std_error", "t"), 6, "p", "e_value")


@query("ols_fit", f"""WITH {OLS} SELECT n, round(1 - sse / sst, 6) AS r2, round(1 - sse / sst * (n - 1) / (n - 3), 6) AS r2_adjusted,
  round((sst - sse) / 2 / s2, 4) AS f, round(n * (ln(2 * pi() * sse / n) + 1) + 6, 2) AS aic FROM se""")
def ols_fit(spark, d):
    _, whole = linear.ols(table(spark, d, OLS_SOURCE), OY, [O1, O2])
    return whole.select(
        "n", F.round("r2", 6).alias("r2"), F.round("r2_adjusted", 6).alias("r2_adjusted"), F.round("f", 4).alias("f"),
        F.round("aic", 2).alias("aic"))


@query("ols_table")
def ols_table(spark, d):
    terms, _ = linear.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"])
    return terms


@query("ols_tiers")
def ols_tiers(spark, d):
    terms, _ = linear.ols(charged_lineitem(spark, d), "charge", ["l_quantity", "l_extendedprice", "l_discount"])
    return linear.tiers(terms)


# Tree models on the encoded orders

def order_vectors(spark, d):
    orders = table(spark, d, "orders")
    prep = Preprocessor(typing.type_map(typing.decide_types(orders)), key="o_orderkey").fit(orders, "o_totalprice")
    return trees.assemble(prep.transform(orders, ("o_orderkey", "o_totalprice")), prep.outputs), prep.outputs


def charge_vectors(spark, d):
    return trees.assemble(charged_lineitem(spark, d), ["l_quantity", "l_extendedprice", "l_discount"])


@query("fit_forest")
def fit_forest(spark, d):
    rows = evaluate.split(charge_vectors(spark, d), "l_orderkey")
    model = trees.fit(trees.forest("charge", depth=5), rows.where("not is_test"))
    return evaluate.metrics(model.transform(rows.where("is_test")), "charge", "pred")


@query("fit_gbt")
def fit_gbt(spark, d):
    rows, _ = order_vectors(spark, d)
    rows = evaluate.split(rows, "o_orderkey")
    model = trees.fit(trees.boosting("o_totalprice"), rows.where("not is_test"))
    return evaluate.metrics(model.transform(rows.where("is_test")), "o_totalprice", "pred")


@query("cv_forest")
def cv_forest(spark, d):
    rows, _ = order_vectors(spark, d)
    folds = evaluate.kfold(rows.select("o_orderkey", "o_totalprice", "features"), "o_orderkey", 3)
    return trees.cross_validate(folds, "o_totalprice", "fold", trees.forest("o_totalprice", trees=20, depth=5))


@query("top_importance")
def top_importance(spark, d):
    model = trees.fit(trees.forest("charge", trees=20, depth=5), charge_vectors(spark, d))
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return trees.top_importance(trees.importances(spark, names, model.featureImportances.toArray()))


@query("interval_trees")
def interval_trees(spark, d):
    rows = charge_vectors(spark, d)
    model = trees.fit(trees.forest("charge", depth=4), rows)
    scored = trees.tree_interval(model, rows)
    return scored.select("l_orderkey", "l_linenumber", "charge", "pred", "ci_low", "ci_high")


# Diagnostics

@query("residuals", f"""WITH {KEY_ROWS} SELECT o_orderkey, y, round(pred, 3) AS pred, round(e, 3) AS residual, round(abs(e), 3) AS abs_residual,
  abs(e) <= (SELECT stddev_pop(e) FROM keyed) AS in_band FROM keyed""")
def residuals(spark, d):
    return rounded(diagnose.residuals(key_rows(spark, d), "y", "pred", ("o_orderkey",)), 3, "pred", "residual", "abs_residual")


@query("pred_extent", f"WITH {KEY_ROWS} SELECT round(least(min(y), min(pred)), 4) AS low, round(greatest(max(y), max(pred)), 4) AS high FROM keyed")
def pred_extent(spark, d):
    return rounded(diagnose.pred_extent(key_rows(spark, d), "y", "pred"), 4, "low", "high")


HALVES = f"{KEY_ROWS}, halves AS (SELECT *, row_number() OVER (ORDER BY pred, o_orderkey) <= count(*) OVER () // 2 AS lower FROM keyed)"
SPREAD = """count(*) FILTER (lower) AS n_low, count(*) FILTER (NOT lower) AS n_high, stddev_pop(e) FILTER (lower) AS lo, stddev_pop(e) FILTER (NOT lower) AS hi"""


@query("half_spread", f"""WITH {HALVES}, s AS (SELECT {SPREAD} FROM halves)
  SELECT n_low, n_high, round(lo, 4) AS std_low, round(hi, 4) AS std_high, round(hi / lo, 6) AS ratio FROM s""")
def half_spread(spark, d):
    rows = key_rows(spark, d).withColumn("residual", F.col("y") - F.col("pred"))
    return rounded(rounded(diagnose.half_spread(rows, "residual", "pred", "o_orderkey"), 4, "std_low", "std_high"), 6, "ratio")


@query("residual_report", f"""WITH {HALVES}, base AS (SELECT avg(e) AS m, stddev_pop(e) AS s FROM keyed),
  s AS (SELECT {SPREAD}, count(*) AS n, count(*) FILTER (abs((e - m) / s) > 3) AS n_outliers,
        100.0 * avg(CAST(abs(e) <= s AS INTEGER)) AS within FROM halves, base)
  SELECT n, round(s, 4) AS std, CASE WHEN abs(m) < 0.05 * s THEN 'none' WHEN m < 0 THEN 'over' ELSE 'under' END AS bias,
    round(hi / lo, 6) AS spread_ratio, CASE WHEN hi / lo < 1.5 THEN 'equal' ELSE 'unequal' END AS spread, n_outliers,
    round(within, 6) AS within_1s_percent, CASE WHEN within >= 65 THEN 'near_normal' ELSE 'irregular' END AS form FROM s, base""")
def residual_report(spark, d):
    found = diagnose.residual_report(key_rows(spark, d), "y", "pred", "o_orderkey").drop("mean")
    return rounded(rounded(found, 4, "std"), 6, "spread_ratio", "within_1s_percent")


@query("scatter_report", f"""WITH {KEY_ROWS}, s AS (SELECT quantile_cont(abs(e), 0.5) AS med, avg(-e) AS bias, max(y) - min(y) AS y_range FROM keyed)
  SELECT round(med, 4) AS median_error, round(med / y_range * 100, 6) AS median_percent,
    CASE WHEN med / y_range * 100 < 5 THEN 'close' WHEN med / y_range * 100 < 15 THEN 'moderate' ELSE 'wide' END AS fit,
    CASE WHEN abs(bias) < 0.02 * y_range THEN 'none' WHEN bias > 0 THEN 'over' ELSE 'under' END AS bias_side FROM s""")
def scatter_report(spark, d):
    found = diagnose.scatter_report(key_rows(spark, d), "y", "pred").drop("bias")
    return rounded(rounded(found, 4, "median_error"), 6, "median_percent")


@query("residual_hist", f"""WITH {CHARGED}, line AS (SELECT regr_slope(charge, l_extendedprice) AS slope, regr_intercept(charge, l_extendedprice) AS icept FROM charged),
  errors AS (SELECT charge - icept - slope * l_extendedprice AS e FROM charged, line),
  s AS (SELECT min(e) AS low, (max(e) - min(e)) / 22 AS width, count(*) AS total FROM errors),
  c AS (SELECT least(floor((e - low) / width), 21) AS bin, count(*) AS n FROM errors, s GROUP BY 1)
  SELECT CAST(i AS INTEGER) AS bin, round(low + i * width, 2) AS low, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * width) * 1000, 6) AS density_per_mille
  FROM range(0, 22) g(i) CROSS JOIN s LEFT JOIN c ON bin = i""")
def residual_hist(spark, d):
    rows = charged_lineitem(spark, d)
    fit = linear.fit_linear(rows, ["l_extendedprice"], "charge")
    errors = rows.select((F.col("charge") - fit.predict()).alias("e"))
    found = shape.histogram(errors, "e", bins=22)
    return found.select("bin", F.round("low", 2).alias("low"), "n", F.round(F.col("density") * 1000, 6).alias("density_per_mille"))


@query("normal_fit", f"""WITH {KEY_ROWS}, s AS (SELECT avg(e) AS m, stddev_pop(e) AS sd, min(e) AS lo, max(e) AS hi FROM keyed),
  g AS (SELECT i, lo + i * ((hi - lo) / 199.0) AS x, m, sd FROM s, range(0, 200) r(i))
  SELECT CAST(i AS INTEGER) AS step, round(x, 4) AS x, round(exp(-pow((x - m) / sd, 2) / 2) / (sd * sqrt(2 * pi())) * 1000, 8) AS density_per_mille FROM g""")
def normal_fit(spark, d):
    rows = key_rows(spark, d).select((F.col("y") - F.col("pred")).alias("e"))
    found = shape.normal_curve(rows, "e")
    return found.select("step", F.round("x", 4).alias("x"), F.round(F.col("density") * 1000, 8).alias("density_per_mille"))


# Scenarios

BASE = """base AS (SELECT o_orderpriority, count(*) AS n_rows, avg(o_totalprice) AS o_totalprice, avg(o_custkey) AS o_custkey FROM orders GROUP BY 1)"""
MODES = """modes AS (SELECT o_orderpriority, o_orderstatus FROM (SELECT o_orderpriority, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderstatus) AS p FROM orders GROUP BY 1, 2) WHERE p = 1)"""
DAYS = """days AS (SELECT o_orderpriority, o_orderdate FROM (SELECT o_orderpriority, o_orderdate,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderdate) AS p FROM orders GROUP BY 1, 2) WHERE p = 1)"""


@query("scenario_baseline", f"""WITH {BASE}, {MODES}, {DAYS} SELECT o_orderpriority, n_rows, round(o_totalprice, 4) AS o_totalprice,
  round(o_custkey, 6) AS o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate
  FROM base JOIN modes USING (o_orderpriority) JOIN days USING (o_orderpriority)""")
def scenario_baseline(spark, d):
    base = scenario.baseline(table(spark, d, "orders"), ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderdate"], ["o_orderpriority"])
    base = base.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rounded(rounded(base, 4, "o_totalprice"), 6, "o_custkey")


LIMITS = "limits AS (SELECT round(CAST(min(o_custkey) AS DOUBLE), 3) AS lo, round(CAST(max(o_custkey) AS DOUBLE), 3) AS hi FROM orders)"
SWEEP = f"{BASE}, {MODES}, {LIMITS}, sweep AS (SELECT o_orderpriority, o_orderstatus, i AS step, lo + i * ((hi - lo) / 49.0) AS o_custkey FROM base JOIN modes USING (o_orderpriority), limits, range(0, 50) g(i))"


def custkey_sweep(spark, d):
    from tabcast.operators.profile import range_defaults

    orders = table(spark, d, "orders")
    base = scenario.baseline(orders, ["o_custkey", "o_orderstatus"], ["o_orderpriority"])
    limits = range_defaults(orders, ["o_custkey"]).first()
    return scenario.sweep(base, "o_custkey", limits["low"], limits["high"])


@query("sweep_grid", f"WITH {SWEEP} SELECT o_orderpriority, o_orderstatus, CAST(step AS INTEGER) AS step, round(o_custkey, 6) AS o_custkey FROM sweep")
def sweep_grid(spark, d):
    return custkey_sweep(spark, d).select("o_orderpriority", "o_orderstatus", "step", F.round("o_custkey", 6).alias("o_custkey"))


PRICE_FIT = f"""{ENCODED_ORDERS}, pm AS (SELECT count(*) AS n, avg(o_custkey) AS m1, avg(o_orderstatus) AS m2, avg(o_totalprice) AS my,
    var_pop(o_custkey) AS a, var_pop(o_orderstatus) AS b, covar_pop(o_custkey, o_orderstatus) AS c, covar_pop(o_custkey, o_totalprice) AS d,
    covar_pop(o_orderstatus, o_totalprice) AS e FROM encoded),
  pf AS (SELECT *, (b * d - c * e) / (a * b - c * c) AS b1, (a * e - c * d) / (a * b - c * c) AS b2 FROM pm),
  price AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM pf),
  rmse AS (SELECT sqrt(avg(pow(o_totalprice - b0 - b1 * o_custkey - b2 * o_orderstatus, 2))) AS rmse, max(o_totalprice) - min(o_totalprice) AS y_range FROM encoded, price)"""
STATUS_CODE = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END"


def price_model(spark, d):
    """A linear price model on customer key and status, with its preprocessing and errors."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    types = {"o_custkey": "integer", "o_orderstatus": "categorical", "o_totalprice": "continuous"}
    prep = Preprocessor(types, key="o_orderkey").fit(orders, "o_totalprice")
    rows = prep.transform(orders, ("o_totalprice",))
    fit = linear.fit_linear(rows, prep.outputs, "o_totalprice")
    error = (linear.squared_error(fit, fit.moments) / fit.moments.n) ** 0.5
    low, high = orders.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return prep, fit, error, high - low


def score(scenarios, prep, fit, keep):
    return prep.transform(scenarios, keep).select(*keep, fit.predict().alias("pred"))


@query("score_scenarios", f"""WITH {PRICE_FIT}, usual AS (SELECT avg(o_custkey) AS ck FROM orders),
  asked AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey AS DOUBLE) END AS o_custkey, CASE WHEN c_nationkey < 10 THEN 'F' WHEN c_nationkey < 20 THEN 'lost' END AS o_orderstatus FROM customer),
  full_rows AS (SELECT c_custkey, coalesce(o_custkey, ck) AS o_custkey, coalesce(o_orderstatus, (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus FROM asked, usual)
  SELECT c_custkey, round(b0 + b1 * o_custkey + b2 * ({STATUS_CODE}), 4) AS pred FROM full_rows, price""")
def score_scenarios(spark, d):
    orders = table(spark, d, "orders")
    prep, fit, _, _ = price_model(spark, d)
    nation = F.col("c_nationkey")
    asked = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_custkey").cast("double")).alias("o_custkey"),
        F.when(nation < 10, "F").when(nation < 20, "lost").alias("o_orderstatus"))
    base = scenario.baseline(orders, ["o_custkey", "o_orderstatus"])
    scored = score(scenario.what_if(base, asked), prep, fit, ("c_custkey",))
    return rounded(scored, 4, "pred")


@query("sweep_predict", f"""WITH {SWEEP}, {PRICE_FIT} SELECT o_orderpriority, CAST(step AS INTEGER) AS step,
  round(b0 + b1 * o_custkey + b2 * ({STATUS_CODE}), 4) AS pred FROM sweep, price""")
def sweep_predict(spark, d):
    prep, fit, _, _ = price_model(spark, d)
    return rounded(score(custkey_sweep(spark, d), prep, fit, ("o_orderpriority", "step")), 4, "pred")


@query("sweep_trend", f"""WITH {SWEEP}, {PRICE_FIT}, s AS (SELECT o_orderpriority, step, o_custkey AS x, b0 + b1 * o_custkey + b2 * ({STATUS_CODE}) AS pred FROM sweep, price),
  ends AS (SELECT o_orderpriority, arg_min(x, step) AS x0, arg_max(x, step) AS x1, arg_min(pred, step) AS p0, arg_max(pred, step) AS p1 FROM s GROUP BY 1)
  SELECT o_orderpriority, round(x0, 4) AS x_first, round(x1, 4) AS x_last, round(p0, 4) AS pred_first, round(p1, 4) AS pred_last,
    round((p1 - p0) / (x1 - x0), 6) AS slope, CASE WHEN p1 > p0 THEN 'rising' WHEN p1 < p0 THEN 'falling' ELSE 'flat' END AS trend FROM ends""")
def sweep_trend(spark, d):
    prep, fit, _, _ = price_model(spark, d)
    rows = custkey_sweep(spark, d).withColumn("x", F.col("o_custkey"))
    found = scenario.sweep_trend(score(rows, prep, fit, ("o_orderpriority", "step", "x")), "x", ["o_orderpriority"])
    return rounded(rounded(found, 4, "x_first", "x_last", "pred_first", "pred_last"), 6, "slope")


@query("interval_rmse", f"""WITH {SWEEP}, {PRICE_FIT}, s AS (SELECT o_orderpriority, step, b0 + b1 * o_custkey + b2 * ({STATUS_CODE}) AS pred FROM sweep, price)
  SELECT o_orderpriority, CAST(step AS INTEGER) AS step, round(pred, 4) AS pred, round(pred - 1.96 * rmse, 4) AS ci_low, round(pred + 1.96 * rmse, 4) AS ci_high FROM s, rmse""")
def interval_rmse(spark, d):
    prep, fit, error, _ = price_model(spark, d)
    scored = score(custkey_sweep(spark, d), prep, fit, ("o_orderpriority", "step"))
    return rounded(scenario.rmse_interval(scored, error), 4, "pred", "ci_low", "ci_high")


@query("interval_bands", f"""WITH {SWEEP}, {PRICE_FIT}, s AS (SELECT o_orderpriority, step, b0 + b1 * o_custkey + b2 * ({STATUS_CODE}) AS pred FROM sweep, price),
  w AS (SELECT o_orderpriority, step, 2 * 1.96 * rmse / pred * 100 AS width, rmse < 0.2 * y_range AS reliable FROM s, rmse)
  SELECT o_orderpriority, CAST(step AS INTEGER) AS step, round(width, 4) AS width_percent,
    CASE WHEN width < 20 THEN 'precise' WHEN width < 50 THEN 'moderate' ELSE 'uncertain' END AS precision, reliable FROM w""")
def interval_bands(spark, d):
    prep, fit, error, y_range = price_model(spark, d)
    scored = score(custkey_sweep(spark, d), prep, fit, ("o_orderpriority", "step"))
    found = scenario.interval_bands(scenario.rmse_interval(scored, error), error, y_range)
    return rounded(found.select("o_orderpriority", "step", "width_percent", "precision", "reliable"), 4, "width_percent")


STARTS = "starts AS (SELECT o_orderpriority, max(o_orderdate) AS start FROM orders GROUP BY 1)"


@query("future_dates", f"""WITH {STARTS} SELECT o_orderpriority, CAST(i AS INTEGER) AS step,
  strftime(start + to_days(CAST(i * 91 AS INTEGER)), '%Y-%m-%d') AS at FROM starts, range(1, 13) g(i)""")
def future_dates(spark, d):
    starts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("start"))
    return scenario.future_dates(starts, F.to_date("start"), 12, "quarter").select("o_orderpriority", "step", "at")


PROJECTION = f"""{STARTS}, {BASE}, trend AS (SELECT regr_slope(o_totalprice, year(o_orderdate)) AS slope, regr_intercept(o_totalprice, year(o_orderdate)) AS icept FROM orders),
  steps AS (SELECT o_orderpriority, i AS step, start + to_days(CAST(i * 365 AS INTEGER)) AS due FROM starts, range(1, 13) g(i)),
  projected AS (SELECT o_orderpriority, step, strftime(due, '%Y-%m-%d') AS at, icept + slope * year(due) AS pred FROM steps, trend)"""


def projected_prices(spark, d):
    """Order price by calendar year, projected twelve years ahead for each priority."""
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    fit = linear.fit_linear(orders, ["year"], "o_totalprice")
    error = (linear.squared_error(fit, fit.moments) / fit.moments.n) ** 0.5
    starts = orders.groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("start"))
    base = scenario.baseline(orders, ["year"], ["o_orderpriority"]).join(starts, "o_orderpriority")
    rows = scenario.project(base, {"year": "integer"}, F.to_date("start"), 12, "year")
    return scenario.rmse_interval(rows.select("o_orderpriority", "step", "at", fit.predict().alias("pred")), error)


@query("project_predict", f"""WITH {PROJECTION}, miss AS (SELECT sqrt(avg(pow(o_totalprice - icept - slope * year(o_orderdate), 2))) AS rmse FROM orders, trend)
  SELECT o_orderpriority, CAST(step AS INTEGER) AS step, "at", round(pred, 4) AS pred, round(pred - 1.96 * rmse, 4) AS ci_low,
    round(pred + 1.96 * rmse, 4) AS ci_high FROM projected, miss""")
def project_predict(spark, d):
    return rounded(projected_prices(spark, d), 4, "pred", "ci_low", "ci_high")


@query("projection_summary", f"""WITH {PROJECTION}, s AS (SELECT o_orderpriority, arg_min(pred, step) AS first, arg_max(pred, step) AS last, max(pred) AS highest, min(pred) AS lowest FROM projected GROUP BY 1)
  SELECT o_orderpriority, round(first, 4) AS first, round(last, 4) AS last, round(highest, 4) AS highest, round(lowest, 4) AS lowest,
    round(last - first, 4) AS change, CASE WHEN last > first THEN 'increase' ELSE 'decrease' END AS movement FROM s""")
def projection_summary(spark, d):
    found = scenario.projection_summary(projected_prices(spark, d), ["o_orderpriority"])
    return rounded(found, 4, "first", "last", "highest", "lowest", "change")


@query("history_plus_projection", f"""WITH {PROJECTION}, miss AS (SELECT sqrt(avg(pow(o_totalprice - icept - slope * year(o_orderdate), 2))) AS rmse FROM orders, trend)
  SELECT 'history' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS at, round(o_totalprice, 4) AS value, NULL AS ci_low, NULL AS ci_high FROM orders
  UNION ALL SELECT 'projection', "at", round(pred, 4), round(pred - 1.96 * rmse, 4), round(pred + 1.96 * rmse, 4) FROM projected, miss""")
def history_plus_projection(spark, d):
    from tabcast.operators.profile import time_series

    past = time_series(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "o_orderkey")
    return rounded(scenario.with_history(past, projected_prices(spark, d)), 4, "value", "ci_low", "ci_high")
