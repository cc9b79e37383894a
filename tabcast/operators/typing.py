"""Semantic type of every column, from one aggregate over the table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabcast.functions import sql
from tabcast.functions import values as V
from tabcast.functions import words
from tabcast.operators.profile import count_distinct, distinct_of, sketch_interval, sketched_distinct

# Aggregated columns per scan; a wider table takes several scans.
COLUMNS_PER_PASS = 50

_UNTYPED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def typed_fields(df: DataFrame) -> list[T.StructField]:
    """Columns that can be typed; nested and binary columns cannot."""
    return [f for f in df.schema if not isinstance(f.dataType, _UNTYPED)]


def _kind(dtype: T.DataType) -> str:
    if V.is_date_type(dtype):
        return "date"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if V.is_integer_type(dtype):
        return "int"
    return "float" if V.is_number_type(dtype) else "other"


def _evidence(field: T.StructField, label: str) -> str:
    """Struct of what one column's values show; unused facts are false."""
    cell, kind = sql.name(field.name), _kind(field.dataType)
    spaced = V.spaced_name(label)
    facts = {"parses": "false", "binary_words": "false", "ordinal_word": "false", "years": "false"}
    if kind == "text":
        word = f"lower(trim({cell}))"
        # One aggregate: a bit for each format that every value so far fits.
        facts["parses"] = f"coalesce(bit_and({V.formats_sql(cell)}) > 0, true)"
        facts["binary_words"] = f"coalesce(bool_and({word} in {sql.words(words.BINARY_WORDS)}), true)"
        facts["ordinal_word"] = f"coalesce(bool_or({word} in {sql.words(words.ORDINAL_WORDS)}), false)"
    elif kind in ("int", "float") and any(k in spaced for k in words.DATE_KEYWORDS):
        facts["years"] = f"coalesce(bool_and({cell} between 1000 and 2999 and {cell} = floor({cell})), false)"
    return sql.struct(
        column=sql.text(field.name), kind=sql.text(kind), id_name=sql.flag(any(k in spaced for k in words.ID_KEYWORDS)),
        n=f"count({cell})", **facts,
    )


def _compared(field: T.StructField) -> str:
    """What makes two values of a column the same for the type rules."""
    cell = sql.name(field.name)
    return V.compact(f"lower(trim({cell}))") if _kind(field.dataType) == "text" else cell


# Number of the first rule that fits, as listed in SURVEY section 1.4.
RULE = """case
  when years then 1
  when kind = 'date' then 2
  when kind = 'text' and parses then 3
  when kind = 'text' and binary_words then 4
  when kind = 'text' and ordinal_word then 5
  when kind = 'text' and id_name and n_unique > 0.9 * n then 6
  when kind = 'text' and (n_unique <= 20 or n_unique < 0.05 * n) then 7
  when kind = 'text' then 8
  when kind = 'bool' then 9
  when kind = 'int' and n_unique = 2 then 10
  when kind = 'int' and id_name and n_unique > 0.9 * n then 11
  when kind = 'int' and n_unique <= 15 then 12
  when kind = 'int' then 13
  when kind = 'float' and n_unique = 2 then 14
  when kind = 'float' then 15
  else 16 end"""

TYPE_OF_RULE = """case
  when rule in (1, 2, 3) then 'date'
  when rule in (4, 9, 10, 14) then 'binary'
  when rule in (5, 12) then 'ordinal'
  when rule in (6, 11) then 'identifier'
  when rule in (7, 16) then 'categorical'
  when rule = 8 then 'text'
  when rule = 13 then 'integer'
  when rule = 15 then 'continuous' end"""


def _limits(facts) -> list[float]:
    """Numbers of different values at which a column's rule may change: beyond each, or at it."""
    kind, n = facts["kind"], facts["n"]
    unique = [0.9 * n] if facts["id_name"] else []
    if kind == "text":
        return [*unique, 20, 0.05 * n]
    return [1, 2, *unique, 15] if kind == "int" else [1, 2] if kind == "float" else []


def _in_doubt(facts) -> bool:
    """Whether counts that the sketch allows lie on both sides of a limit."""
    low, high = sketch_interval(facts["estimate"])
    return low < high and any(low <= limit + 1 and high >= limit - 1 for limit in _limits(facts))


def decide_types(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One row per column: column, type, n, rule, and whether its different values were counted.

    Types and rules are those of ``detect_types``, from one scan: a sketch
    tells on which side of the rules' limits a column lies. Only columns for
    which it does not are counted exactly. Nothing is shuffled for the others.
    """
    spark, fields, found = df.sparkSession, typed_fields(df), []
    for start in range(0, len(fields), COLUMNS_PER_PASS):
        batch = fields[start:start + COLUMNS_PER_PASS]
        facts = [_evidence(f, (names or {}).get(f.name, f.name)) for f in batch]
        estimates = [sketched_distinct(_compared(f)) for f in batch]
        row = df.agg(F.expr(f"array({', '.join(facts)})"), F.expr(f"array({', '.join(estimates)})")).first()
        found += [{**facts.asDict(), "estimate": estimate} for facts, estimate in zip(*row)]
    doubtful = {r["column"] for r in found if _in_doubt(r)}
    counts = count_distinct(df, {f.name: _compared(f) for f in fields if f.name in doubtful})
    counted = {r["column"]: r["n_unique"] for r in counts.collect()} if doubtful else {}
    rows = [(*(r[k] for k in _FACTS), counted.get(r["column"], r["estimate"]), r["column"] in counted) for r in found]
    schema = ", ".join(f"{k} {t}" for k, t in _FACTS.items()) + ", n_unique bigint, counted boolean"
    decided = spark.createDataFrame(rows, schema).withColumn("rule", F.expr(RULE))
    return decided.withColumn("type", F.expr(TYPE_OF_RULE)).select("column", "type", "n", "rule", "counted")


_FACTS = {
    "column": "string", "kind": "string", "id_name": "boolean", "n": "bigint", "parses": "boolean",
    "binary_words": "boolean", "ordinal_word": "boolean", "years": "boolean",
}


def detect_types(df: DataFrame, names: dict[str, str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column: column, type, n, n_unique, rule.

    ``names`` gives other names to judge columns by. ``exact=False`` counts
    distinct values by a mergeable sketch, which spares the shuffle of every
    distinct value of every column.
    """
    return _detected(df, names or {}, exact, raw=False).select("column", "type", "n", "n_unique", "rule")


def _detected(df: DataFrame, names: dict[str, str], exact: bool, raw: bool) -> DataFrame:
    """Facts and distinct counts per column; ``raw`` adds ``n_distinct`` of the values as they are."""
    fields = typed_fields(df)
    result = None
    for start in range(0, len(fields), COLUMNS_PER_PASS):
        batch = fields[start:start + COLUMNS_PER_PASS]
        facts = [_evidence(f, names.get(f.name, f.name)) for f in batch]
        part = df.agg(F.expr(f"array({', '.join(facts)})").alias("facts"), F.expr("count(1)").alias("n_rows"))
        part = part.select("n_rows", F.inline("facts"))
        counts = {f.name: _compared(f) for f in batch}
        if raw:
            counts |= {f"{f.name}|raw": distinct_of(df, f.name) for f in batch if _kind(f.dataType) == "text"}
        unique = count_distinct(df, counts, exact)
        part = part.join(unique, "column")
        if raw:
            as_is = unique.where(F.col("column").endswith("|raw")).select(
                F.regexp_replace("column", r"\|raw$", "").alias("column"), F.col("n_unique").alias("n_distinct"))
            part = part.join(as_is, "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", "n_unique"))
        result = part if result is None else result.unionByName(part)
    return result.withColumn("rule", F.expr(RULE)).withColumn("type", F.expr(TYPE_OF_RULE))


def type_map(detected: DataFrame) -> dict[str, str]:
    """Types as a dictionary; one entry per column of the table."""
    return {r["column"]: r["type"] for r in detected.select("column", "type").collect()}


def type_counts(detected: DataFrame) -> DataFrame:
    return detected.groupBy("type").agg(F.count(F.lit(1)).alias("n_columns"))


TYPE_LABEL = sql.table_lookup(words.TYPE_LABELS, "type")
TYPE_ADVICE = sql.table_lookup(words.TYPE_ADVICE, "type")


def with_advice(detected: DataFrame) -> DataFrame:
    return detected.selectExpr("column", "type", f"{TYPE_ADVICE} as advice")


def explore_table(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, label, distinct values, share of nulls in percent and advice per column."""
    found = _detected(df, {}, exact, raw=True)
    return found.selectExpr(
        "column", "type", f"{TYPE_LABEL} as label", "n_distinct",
        "round(100D * (n_rows - n) / greatest(n_rows, 1), 1) as null_percent", f"{TYPE_ADVICE} as advice",
    )
