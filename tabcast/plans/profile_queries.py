"""Queries over sources, typing, profiles, association and distribution shapes."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.functions import values as V
from tabcast.operators import assoc, profile, shape, typing
from tabcast.plans.registry import query, table
from tabcast.sources import tables

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def gappy_lineitem(spark, d):
    """Line items with zero discounts and taxes taken as missing."""
    return table(spark, d, "lineitem").withColumns({
        "l_discount": F.nullif("l_discount", F.lit(0.0)),
        "l_tax": F.nullif("l_tax", F.lit(0.0)),
        "l_returnflag": F.nullif("l_returnflag", F.lit("N")),
    })


GAPPY = """gappy AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax,
         nullif(l_returnflag, 'N') AS l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)"""


def charged_lineitem(spark, d):
    """Line items with the charge and a rebate that follow from price and discount."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("charge"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("rebate"),
    )


CHARGED = """charged AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
         l_extendedprice * (1 - l_discount) AS charge, l_extendedprice * l_discount AS rebate
  FROM lineitem)"""
CHARGED_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "charge", "rebate"]


def union_sql(columns, template, glue="\nUNION ALL\n"):
    return glue.join(template.format(c=c) for c in columns)


# Sources and column choice

ORDERS_TEXT_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""


@query("csv_roundtrip", ORDERS_TEXT_SQL)
def csv_roundtrip(spark, d):
    path = f"{tables.work_folder(spark)}/orders"
    orders = table(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders.write.csv(path, header=True, escape='"')
    return tables.read_table(spark, path)


@query("preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def preview(spark, d):
    return tables.preview(table(spark, d, "customer"), "c_custkey")


@query("shape", "SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_cols FROM lineitem")
def shape_of(spark, d):
    return tables.shape(table(spark, d, "lineitem"))


@query("select_by_type", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_by_type(spark, d):
    part = table(spark, d, "part")
    return tables.select_by_type(part, typing.type_map(typing.decide_types(part)), "continuous", "integer")


@query("default_target", """SELECT 'l_tax' AS target, 'l_orderkey' AS study_x, 'l_partkey' AS study_y, CAST(7 AS INTEGER) AS n_features
  FROM lineitem LIMIT 1""")
def default_target(spark, d):
    lineitem = table(spark, d, "lineitem")
    target = tables.default_target(typing.type_map(typing.decide_types(lineitem)))
    study = tables.default_study(lineitem)
    return spark.createDataFrame(
        [(target, study["x"], study["y"], len(study["features"]))],
        "target string, study_x string, study_y string, n_features int",
    )


@query("pair_complete", f"""WITH {GAPPY}
  SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM gappy WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def pair_complete(spark, d):
    rows = gappy_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return tables.complete_rows(rows, ["l_discount", "l_tax"])


# Typing: facts per column, then the numbered rules

TYPED_TABLES = {
    "lineitem": {
        "int": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
        "float": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        "text": ["l_returnflag", "l_linestatus"], "date": ["l_shipdate"],
    },
    "orders": {
        "int": ["o_orderkey", "o_custkey"], "text": ["o_orderstatus", "o_orderpriority"],
        "float": ["o_totalprice"], "date": ["o_orderdate"],
    },
    "events": {
        "int": ["event_id", "user_id"], "date": ["ts"], "text": ["event_type", "props"], "float": ["value"],
    },
    "documents": {"int": ["doc_id", "n_chars"], "text": ["text", "lang", "source"]},
    "labels": {"int": ["doc_id", "quality", "toxic"]},
    "part": {"int": ["p_partkey", "p_size"], "text": ["p_name", "p_brand", "p_type"], "float": ["p_retailprice"]},
    "conversations": {"int": ["conv_id", "turn"], "text": ["role", "text"]},
    "nation": {"int": ["n_nationkey", "n_regionkey"], "text": ["n_name"]},
}
ID_NAME = r"id|code|ref|numero|num|no|index|identifiant|matricule|cle"
BINARY_SQL = "('0','1','oui','non','yes','no','true','false','vrai','faux','m','f','male','female','homme','femme')"
ORDINAL_SQL = (
    "('faible','moyen','fort','élevé','low','medium','high','très faible','très fort','mauvais','passable','bien',"
    "'très bien','excellent','débutant','intermédiaire','avancé','expert','1er','2ème','3ème','4ème','5ème')"
)


def facts_sql(source, columns_by_kind):
    rows = []
    for kind, columns in columns_by_kind.items():
        for c in columns:
            if kind == "text":
                word = f"lower(trim({c}))"
                facts = (
                    f"coalesce(bool_and(regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')), true) AS parses, "
                    f"coalesce(bool_and({word} IN {BINARY_SQL}), true) AS two_words, "
                    f"coalesce(bool_or({word} IN {ORDINAL_SQL}), false) AS ranked"
                )
            else:
                word, facts = c, "false AS parses, false AS two_words, false AS ranked"
            rows.append(
                f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count({c}) AS n, count(DISTINCT {word}) AS n_unique, "
                f"count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows, {facts} FROM {source}"
            )
    return "\nUNION ALL\n".join(rows)


def types_sql(source, columns_by_kind):
    return f"""SELECT *, CASE rule WHEN 2 THEN 'date' WHEN 3 THEN 'date' WHEN 4 THEN 'binary' WHEN 10 THEN 'binary'
    WHEN 14 THEN 'binary' WHEN 5 THEN 'ordinal' WHEN 12 THEN 'ordinal' WHEN 6 THEN 'identifier' WHEN 11 THEN 'identifier'
    WHEN 7 THEN 'categorical' WHEN 8 THEN 'text' WHEN 13 THEN 'integer' WHEN 15 THEN 'continuous' END AS "type"
  FROM (SELECT *, CAST(CASE
    WHEN kind = 'date' THEN 2
    WHEN kind = 'text' AND parses THEN 3
    WHEN kind = 'text' AND two_words THEN 4
    WHEN kind = 'text' AND ranked THEN 5
    WHEN kind = 'text' AND id_name AND n_unique > 0.9 * n THEN 6
    WHEN kind = 'text' AND (n_unique <= 20 OR n_unique < 0.05 * n) THEN 7
    WHEN kind = 'text' THEN 8
    WHEN kind = 'int' AND n_unique = 2 THEN 10
    WHEN kind = 'int' AND id_name AND n_unique > 0.9 * n THEN 11
    WHEN kind = 'int' AND n_unique <= 15 THEN 12
    WHEN kind = 'int' THEN 13
    WHEN n_unique = 2 THEN 14
    ELSE 15 END AS INTEGER) AS rule
  FROM (SELECT *, regexp_matches(replace(lower("column"), '_', ' '), '{ID_NAME}') AS id_name
        FROM ({facts_sql(source, columns_by_kind)})))"""


TYPE_COLUMNS_SQL = 'SELECT "column", "type", n, n_unique, rule'


@query("detect_types", "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS table_name, "column", "type", n, n_unique, rule FROM ({types_sql(name, kinds)})"""
    for name, kinds in TYPED_TABLES.items()
))
def detect_types(spark, d):
    parts = [
        typing.detect_types(table(spark, d, name)).select(F.lit(name).alias("table_name"), "*") for name in TYPED_TABLES
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("decide_types", "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS table_name, "column", "type", n, rule FROM ({types_sql(name, kinds)})"""
    for name, kinds in TYPED_TABLES.items()
))
def decide_types(spark, d):
    """The same types, from sketches and as few exact counts as the rules need."""
    parts = [
        typing.decide_types(table(spark, d, name)).select(F.lit(name).alias("table_name"), "column", "type", "n", "rule")
        for name in TYPED_TABLES
    ]
    return functools.reduce(DataFrame.unionByName, parts)


@query("type_counts", f"""SELECT "type", count(*) AS n_columns FROM ({types_sql('lineitem', TYPED_TABLES['lineitem'])}) GROUP BY "type" """)
def type_counts(spark, d):
    return typing.type_counts(typing.detect_types(table(spark, d, "lineitem")))


ADVICE_SQL = """CASE "type" WHEN 'date' THEN 'split into calendar parts or use as the axis of a series'
  WHEN 'binary' THEN 'compare the two groups or use as a class target' WHEN 'identifier' THEN 'leave out of models'
  WHEN 'categorical' THEN 'encode before modelling' WHEN 'ordinal' THEN 'encode as ordered codes'
  WHEN 'continuous' THEN 'use directly after checking spread and outliers'
  WHEN 'integer' THEN 'use directly or cut into classes' WHEN 'text' THEN 'leave out or turn into numbers first' END AS advice"""
LABEL_SQL = """CASE "type" WHEN 'date' THEN 'Date or time' WHEN 'binary' THEN 'Binary' WHEN 'identifier' THEN 'Identifier'
  WHEN 'categorical' THEN 'Categorical' WHEN 'ordinal' THEN 'Ordinal' WHEN 'continuous' THEN 'Continuous'
  WHEN 'integer' THEN 'Integer' WHEN 'text' THEN 'Free text' END AS label"""


@query("type_advice", f"""SELECT "column", "type", {ADVICE_SQL} FROM ({types_sql('events', TYPED_TABLES['events'])})""")
def type_advice(spark, d):
    return typing.with_advice(typing.detect_types(table(spark, d, "events")))


@query("explore", f"""WITH {GAPPY} SELECT "column", "type", {LABEL_SQL}, n_distinct,
  round(100.0 * (n_rows - n) / n_rows, 1) AS null_percent, {ADVICE_SQL}
  FROM ({types_sql('gappy', TYPED_TABLES['lineitem'])})""")
def explore(spark, d):
    return typing.explore_table(gappy_lineitem(spark, d))


SOLD = """CASE WHEN o_orderstatus = 'F' THEN ' Oui ' WHEN o_orderstatus = 'O' THEN 'non' END"""
URGENCY = "lower(substr(o_orderpriority, 3))"


@query("detect_binary", f"""{TYPE_COLUMNS_SQL} FROM ({types_sql(f'(SELECT {SOLD} AS sold FROM orders)', {'text': ['sold']})})""")
def detect_binary(spark, d):
    return typing.detect_types(table(spark, d, "orders").select(F.expr(SOLD).alias("sold")))


@query("detect_ordinal", f"""{TYPE_COLUMNS_SQL} FROM ({types_sql(f'(SELECT {URGENCY} AS urgency FROM orders)', {'text': ['urgency']})})""")
def detect_ordinal(spark, d):
    return typing.detect_types(table(spark, d, "orders").select(F.expr(URGENCY).alias("urgency")))


# Profiles

@query("profile_numeric", f"WITH {GAPPY}\n" + union_sql(NUMBERS, """SELECT '{c}' AS "column", round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max,
  round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS median, count(DISTINCT {c}) AS n_unique,
  count(*) - count({c}) AS nulls FROM gappy"""))
def profile_numeric(spark, d):
    return profile.profile_numeric(gappy_lineitem(spark, d), NUMBERS)


@query("describe", f"WITH {GAPPY}\n" + union_sql(NUMBERS, """SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min,
  round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q25, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS q50,
  round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM gappy"""))
def describe(spark, d):
    return profile.describe(gappy_lineitem(spark, d), NUMBERS, digits=4)


def top3_sql(source, c):
    """Three most frequent values of one column, on one row."""
    return f"""SELECT '{c}' AS "column", max(CASE WHEN p = 1 THEN v END) AS top1, max(CASE WHEN p = 2 THEN v END) AS top2,
    max(CASE WHEN p = 3 THEN v END) AS top3
  FROM (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS p
        FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1))"""


@query("profile_categorical", f"WITH {GAPPY}\n" + "\nUNION ALL\n".join(
    f"""SELECT t.*, u.top1, u.top2, u.top3 FROM (SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique,
  count(*) - count({c}) AS nulls FROM {source}) t JOIN ({top3_sql(source, c)}) u ON t."column" = u."column" """
    for source, c in (("gappy", "l_returnflag"), ("gappy", "l_linestatus"), ("documents", "lang"), ("documents", "text"))
))
def profile_categorical(spark, d):
    items = profile.profile_categorical(gappy_lineitem(spark, d), ["l_returnflag", "l_linestatus"])
    return items.unionByName(profile.profile_categorical(table(spark, d, "documents"), ["lang", "text"]))


@query("distinct_counts", union_sql(
    [*NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"],
    """SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM lineitem""",
))
def distinct_counts(spark, d):
    lineitem = table(spark, d, "lineitem")
    return profile.distinct_counts(lineitem, lineitem.columns)


@query("null_share", f"WITH {GAPPY}\n" + union_sql(
    [*NUMBERS, "l_returnflag"],
    """SELECT '{c}' AS "column", round(100.0 * (count(*) - count({c})) / count(*), 1) AS null_percent FROM gappy""",
))
def null_share(spark, d):
    return profile.null_share(gappy_lineitem(spark, d), [*NUMBERS, "l_returnflag"])


@query("value_counts", """SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "lineitem"), "l_partkey")


@query("top_values", "\nUNION ALL\n".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", v AS value, n, CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS place
  FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1)) WHERE place <= 3"""
    for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
))
def top_values(spark, d):
    return profile.top_values(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"], 3)


@query("column_modes", "\nUNION ALL\n".join(
    f"""(SELECT '{c}' AS "column", v AS "mode", n FROM (SELECT {c} AS v, count(*) AS n FROM {t} GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"""
    for t, c in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("documents", "text"), ("documents", "lang"))
))
def column_modes(spark, d):
    orders = profile.modes(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    return orders.unionByName(profile.modes(table(spark, d, "documents"), ["text", "lang"]))


@query("choices", "SELECT DISTINCT p_name AS value FROM part ORDER BY 1 LIMIT 20")
def choices(spark, d):
    return profile.choices(table(spark, d, "part"), "p_name")


@query("range_defaults", f"WITH {GAPPY}\n" + union_sql(NUMBERS, """SELECT '{c}' AS "column",
  round(CAST(min({c}) AS DOUBLE), 3) AS low, round(CAST(max({c}) AS DOUBLE), 3) AS high FROM gappy"""))
def range_defaults(spark, d):
    return profile.range_defaults(gappy_lineitem(spark, d), NUMBERS)


@query("time_series", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, nullif(value, 0.0) AS value
  FROM events WHERE nullif(value, 0.0) IS NOT NULL ORDER BY ts, event_id""")
def time_series(spark, d):
    events = table(spark, d, "events").withColumn("value", F.nullif("value", F.lit(0.0)))
    series = profile.time_series(events, "ts", "value", "event_id")
    return series.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "value")


# Cell expressions

@query("normalise_text", r"""SELECT p_partkey, lower(trim('  ' || p_brand || ' ')) AS brand, lower(trim(p_type)) AS kind FROM part""")
def normalise_text(spark, d):
    padded = F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "))
    return table(spark, d, "part").select(
        "p_partkey", V.normalise_text(padded).alias("brand"), V.normalise_text(F.col("p_type")).alias("kind"))


MIXED_NUMBER = "CASE WHEN o_orderstatus = 'F' THEN substr(o_orderpriority, 1, 1) || '.5' ELSE o_orderpriority END"
MIXED_DATE = """CASE o_orderstatus WHEN 'F' THEN {iso} WHEN 'O' THEN {day_first} ELSE 'unknown' END"""


@query("coerce_numeric", f"SELECT o_orderkey, TRY_CAST({MIXED_NUMBER} AS DOUBLE) AS amount FROM orders")
def coerce_numeric(spark, d):
    from tabcast.operators.encode import coerce_numeric as coerce

    rows = table(spark, d, "orders").select("o_orderkey", F.expr(MIXED_NUMBER).alias("amount"))
    return coerce(rows, ["amount"])


@query("coerce_date", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN o_orderstatus = 'O' AND day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""")
def coerce_date(spark, d):
    text = F.expr(MIXED_DATE.format(
        iso="date_format(o_orderdate, 'yyyy-MM-dd')", day_first="date_format(o_orderdate, 'dd/MM/yyyy')"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(V.parse_date(text), "yyyy-MM-dd").alias("parsed"))


@query("date_parts", """SELECT o_orderkey, CAST(coalesce(year(stamp), 0) AS INTEGER) AS year, CAST(coalesce(month(stamp), 0) AS INTEGER) AS month,
  CAST(coalesce(isodow(stamp) - 1, 0) AS INTEGER) AS dayofweek, CAST(coalesce(dayofyear(stamp), 0) AS INTEGER) AS dayofyear
  FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS stamp FROM orders)""")
def date_parts(spark, d):
    orders = table(spark, d, "orders")
    at = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return orders.select("o_orderkey", *[part.alias(name) for name, part in V.date_parts(at).items()])


# Association

def r_sql(a, b):
    return f"CASE WHEN var_pop({a}) FILTER ({b} IS NOT NULL) > 0 AND var_pop({b}) FILTER ({a} IS NOT NULL) > 0 THEN corr({a}, {b}) END"


def pairs_sql(source, columns):
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS c1, '{b}' AS c2, regr_count({b}, {a}) AS n, {r_sql(a, b)} AS r FROM {source}"
        for i, a in enumerate(columns) for b in columns[i + 1:]
    )


BANDED_PAIRS_SQL = """SELECT c1, c2, CAST(n AS BIGINT) AS n, round(r, 4) AS r,
  CASE WHEN abs(r) >= 0.9 THEN 'very_strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate'
       WHEN abs(r) >= 0.3 THEN 'weak' WHEN r IS NOT NULL THEN 'very_weak' END AS strength,
  CASE WHEN r > 0 THEN 'positive' WHEN r IS NOT NULL THEN 'negative' END AS direction,
  CASE WHEN abs(r) >= 0.9 THEN 'near linear, risk of collinearity' WHEN abs(r) >= 0.7 THEN 'strong dependence, good predictor'
       WHEN abs(r) >= 0.5 THEN 'visible tendency' WHEN abs(r) >= 0.3 THEN 'slight tendency'
       WHEN r IS NOT NULL THEN 'no visible link' END AS meaning"""


@query("pearson_pairs", f"""WITH {GAPPY}, {CHARGED}, pairs AS ({pairs_sql('gappy', NUMBERS)} UNION ALL {pairs_sql('charged', CHARGED_NUMBERS)})
  {BANDED_PAIRS_SQL} FROM pairs""")
def pearson_pairs(spark, d):
    gappy = assoc.pearson_pairs(gappy_lineitem(spark, d), NUMBERS)
    return gappy.unionByName(assoc.pearson_pairs(charged_lineitem(spark, d), CHARGED_NUMBERS))


@query("top_pairs", f"""WITH {CHARGED}, pairs AS ({pairs_sql('charged', CHARGED_NUMBERS)})
  SELECT c1, c2, CAST(n AS BIGINT) AS n, round(r, 6) AS r FROM pairs ORDER BY abs(pairs.r) DESC, c1, c2 LIMIT 3""")
def top_pairs(spark, d):
    return assoc.top_pairs(charged_lineitem(spark, d), CHARGED_NUMBERS).withColumn("r", F.round("r", 6))


@query("multicollinear", f"""WITH {CHARGED}, pairs AS ({pairs_sql('charged', CHARGED_NUMBERS)})
  SELECT c1, c2, CAST(n AS BIGINT) AS n, round(r, 6) AS r FROM pairs WHERE abs(pairs.r) >= 0.7""")
def multicollinear(spark, d):
    return assoc.collinear_pairs(charged_lineitem(spark, d), CHARGED_NUMBERS, 0.7).withColumn("r", F.round("r", 6))


PAIR_SQL = f"""{CHARGED}, base AS (SELECT CAST(regr_count(rebate, l_extendedprice) AS BIGINT) AS n, corr(l_extendedprice, rebate) AS r FROM charged),
  pair AS (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM base)"""


@query("pearson_pair", f"""WITH {PAIR_SQL} SELECT n, round(r, 6) AS r, round(r * r, 6) AS r2, round(t, 4) AS t,
  CASE WHEN abs(r) >= 0.8 THEN 'very_strong' WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate'
       WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM pair""")
def pearson_pair(spark, d):
    found = assoc.pearson_pair(charged_lineitem(spark, d), "l_extendedprice", "rebate")
    return found.withColumns({c: F.round(c, 6) for c in ("r", "r2")} | {"t": F.round("t", 4)})


def p_sql(t, free):
    """Two-sided p of a t statistic: Simpson's rule on the density from 0 to |t|."""
    density = f"exp(lgamma(({free} + 1) / 2.0) - lgamma({free} / 2.0)) / sqrt({free} * pi()) * pow(1 + u * u / {free}, -({free} + 1) / 2.0)"
    return f"""(SELECT 1 - 2 * sum(w * {density}) * abs({t}) / 4000 / 3 FROM (
      SELECT abs({t}) * i / 4000.0 AS u, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
      FROM range(0, 4001) g(i)))"""


@query("pearson_pvalue", f"""WITH {GAPPY}, base AS (SELECT CAST(regr_count(l_tax, l_discount) AS BIGINT) AS n, corr(l_discount, l_tax) AS r FROM gappy),
  pair AS (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM base),
  found AS (SELECT n, t, {p_sql('t', '(n - 2)')} AS p FROM pair)
  SELECT n, round(t, 4) AS t, round(p, 6) AS p, p < 0.05 AS significant FROM found""")
def pearson_pvalue(spark, d):
    found = assoc.study_pair(gappy_lineitem(spark, d), "l_discount", "l_tax")
    return found.select("n", F.round("t", 4).alias("t"), F.round("p", 6).alias("p"), "significant")


@query("average_rank", """SELECT value, CAST(n AS BIGINT) AS n, CAST(before + (n + 1) / 2.0 AS DOUBLE) AS avg_rank FROM (
  SELECT value, n, sum(n) OVER (ORDER BY value) - n AS before
  FROM (SELECT o_totalprice AS value, count(*) AS n FROM orders GROUP BY 1))""")
def average_rank(spark, d):
    return assoc.average_ranks(table(spark, d, "orders"), "o_totalprice")


@query("spearman_pair", f"""WITH {GAPPY}, whole AS (SELECT l_discount AS x, l_extendedprice * l_tax AS y FROM gappy WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL),
  ranked AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a,
                    rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM whole)
  SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM ranked""")
def spearman_pair(spark, d):
    rows = gappy_lineitem(spark, d).withColumn("duty", F.col("l_extendedprice") * F.col("l_tax"))
    found = assoc.spearman_pair(rows, "l_discount", "duty")
    return found.withColumn("rho", F.round("rho", 6))


@query("fit_line", f"""WITH {CHARGED}, line AS (SELECT regr_slope(charge, l_extendedprice) AS slope, regr_intercept(charge, l_extendedprice) AS intercept,
    min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM charged)
  SELECT CAST(i AS INTEGER) AS step, round(low + i * ((high - low) / 199.0), 4) AS x,
         round(intercept + slope * (low + i * ((high - low) / 199.0)), 4) AS y FROM line, range(0, 200) g(i)""")
def fit_line(spark, d):
    points = assoc.line_points(charged_lineitem(spark, d), "l_extendedprice", "charge")
    return points.select("step", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("zscore_pair", """SELECT o_orderkey, round((o_totalprice - m1) / s1, 6) AS o_totalprice, round((o_custkey - m2) / s2, 6) AS o_custkey
  FROM orders, (SELECT avg(o_totalprice) AS m1, stddev_samp(o_totalprice) AS s1, avg(o_custkey) AS m2, stddev_samp(o_custkey) AS s2 FROM orders)""")
def zscore_pair(spark, d):
    scores = assoc.zscores(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], "o_orderkey")
    return scores.withColumns({c: F.round(c, 6) for c in ("o_totalprice", "o_custkey")})


# Shapes

def bins_sql(source, column, bins):
    return f"""SELECT CAST(g.i AS INTEGER) AS bin, low + g.i * width AS low, low + (g.i + 1) * width AS high, coalesce(c.n, 0) AS n,
    coalesce(c.n, 0) / (total * width) AS density
  FROM range(0, {bins}) g(i)
  CROSS JOIN (SELECT min({column}) AS low, (max({column}) - min({column})) / {bins} AS width, count({column}) AS total FROM {source}) s
  LEFT JOIN (SELECT least(floor(({column} - low) / width), {bins - 1}) AS bin, count(*) AS n
             FROM {source}, (SELECT min({column}) AS low, (max({column}) - min({column})) / {bins} AS width FROM {source})
             WHERE {column} IS NOT NULL GROUP BY 1) c ON c.bin = g.i"""


@query("histogram", f"""SELECT bin, round(low, 4) AS low, round(high, 4) AS high, n, round(density * 1000, 6) AS density_per_mille
  FROM ({bins_sql('lineitem', 'l_extendedprice', 25)})""")
def histogram(spark, d):
    found = shape.histogram(table(spark, d, "lineitem"), "l_extendedprice")
    return found.select(
        "bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n",
        F.round(F.col("density") * 1000, 6).alias("density_per_mille"))


@query("boxplot", f"WITH {GAPPY}\n" + union_sql(
    ["l_quantity", "l_extendedprice", "l_discount"],
    """SELECT '{c}' AS "column", round((q1 - m) / s, 6) AS q25, round((q2 - m) / s, 6) AS q50, round((q3 - m) / s, 6) AS q75,
  round((min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) - m) / s, 6) AS whisker_low,
  round((max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) - m) / s, 6) AS whisker_high,
  count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
  FROM gappy, (SELECT avg({c}) AS m, stddev_samp({c}) AS s, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
               quantile_cont({c}, 0.75) AS q3 FROM gappy) GROUP BY q1, q2, q3, m, s""",
))
def boxplot(spark, d):
    found = shape.boxplot(gappy_lineitem(spark, d), ["l_quantity", "l_extendedprice", "l_discount"])
    return found.withColumns({c: F.round(c, 6) for c in ("q25", "q50", "q75", "whisker_low", "whisker_high")})


@query("kde", """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
  z AS (SELECT (l_quantity - m) / sd AS z, count(*) AS w FROM lineitem, s GROUP BY 1),
  grid AS (SELECT i, lo - 0.5 * (hi - lo) + i * (2 * (hi - lo) / 999.0) AS x, n, pow(n, -0.2) AS h
           FROM (SELECT n, (lo - m) / sd AS lo, (hi - m) / sd AS hi FROM s), range(0, 1000) g(i))
  SELECT CAST(i AS INTEGER) AS step, round(x, 6) AS x, round(sum(w * exp(-0.5 * pow((x - z) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
  FROM grid, z GROUP BY i, x, n, h""")
def kde(spark, d):
    found = shape.kde(table(spark, d, "lineitem"), "l_quantity", exact=True)
    return found.select("step", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@query("kde_binned", """WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
  z AS (SELECT (l_extendedprice - m) / sd AS z, count(*) AS w FROM lineitem, s GROUP BY 1),
  grid AS (SELECT i, lo - 0.5 * (hi - lo) + i * (2 * (hi - lo) / 199.0) AS x, n, pow(n, -0.2) AS h
           FROM (SELECT n, (lo - m) / sd AS lo, (hi - m) / sd AS hi FROM s), range(0, 200) g(i))
  SELECT CAST(i AS INTEGER) AS step, round(x, 6) AS x, round(sum(w * exp(-0.5 * pow((x - z) / h, 2))) / (n * h * sqrt(2 * pi())), 5) AS density
  FROM grid, z GROUP BY i, x, n, h""")
def kde_binned(spark, d):
    """A column of which nearly all values differ; binning keeps the density within 1e-6 of the kernel's peak."""
    found = shape.kde(table(spark, d, "lineitem"), "l_extendedprice", 200)
    return found.select("step", F.round("x", 6).alias("x"), F.round("density", 5).alias("density"))


@query("hexbin", """WITH s AS (SELECT min(l_quantity) - 1e-9 * (max(l_quantity) - min(l_quantity)) AS x0, max(l_quantity) + 1e-9 * (max(l_quantity) - min(l_quantity)) AS x1,
    min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem),
  p AS (SELECT (l_quantity - x0) / ((x1 - x0) / 22) AS u, (l_extendedprice - y0) / ((y1 - y0) / 12) AS v, x0, y0,
               (x1 - x0) / 22 AS sx, (y1 - y0) / 12 AS sy FROM lineitem, s),
  c AS (SELECT *, pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2)
                < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS corner FROM p)
  SELECT round(CASE WHEN corner THEN round_even(u, 0) ELSE floor(u) + 0.5 END * sx + x0, 4) AS x,
         round(CASE WHEN corner THEN round_even(v, 0) ELSE floor(v) + 0.5 END * sy + y0, 4) AS y, count(*) AS n FROM c GROUP BY 1, 2""")
def hexbin(spark, d):
    found = shape.hexbin(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return found.select(F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "n")
