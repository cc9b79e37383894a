"""Reading CSV files with type inference, previews, shapes and column choice."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabcast.functions import sql
from tabcast.functions import values as V
from tabcast.functions.words import MISSING_WORDS


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read a table; CSV cells holding a missing word become null before typing.

    A given ``schema`` saves the inference pass. Large CSV files are split
    among tasks where ``lines_are_records`` allows; a given ``multi_line``
    saves the pass that tells.
    """
    if fmt != "csv":
        reader = spark.read.format(fmt)
        return V.nan_to_null((reader.schema(schema) if schema else reader).load(path))
    if multi_line is None:
        multi_line = not lines_are_records(spark, path)
    cells = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    cells = cells.selectExpr(*[
        f"case when {sql.name(c)} not in {sql.words(MISSING_WORDS)} then {sql.name(c)} end as {sql.name(c)}" for c in cells.columns
    ])
    types = {f.name: f.dataType.simpleString() for f in schema} if schema else infer_types(cells)
    return cells.selectExpr(*[f"try_cast({sql.name(c)} as {types[c]}) as {sql.name(c)}" for c in cells.columns])


def lines_are_records(spark: SparkSession, path: str) -> bool:
    """True when each line of the CSV files is a record by itself, told by one distributed pass over the lines.

    Then a reader that splits files at line ends finds the same rows as one
    that reads each file in one task. A line passes if every quote in it
    belongs to a whole quoted cell, doubled quotes aside. Lines of blanks
    only, carriage returns within lines and mixed line ends do not pass: the
    two readers treat them differently.
    """
    lines = spark.read.text(path, lineSep="\n")
    line = F.regexp_replace("value", r"\r\z", "")
    unquoted = F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), r'(?:^|(?<=,))"[^"]*"(?=,|\z)', "")
    doubtful = unquoted.contains('"') | line.contains("\r") | line.rlike(r"\A[\x00-\x20]+\z")
    found = lines.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").endswith("\r")).alias("returns"), F.count_if(doubtful).alias("doubtful"),
    ).first()
    return not found["doubtful"] and found["returns"] in (0, found["lines"])


def infer_types(cells: DataFrame) -> dict[str, str]:
    """Narrowest of bigint, double, boolean and string that every cell fits, in one pass."""
    fits = []
    for i, c in enumerate(cells.columns):
        x = sql.name(c)
        tests = {
            "bigint": f"{x} rlike '^ *[+-]?[0-9]{{1,19}} *$' and try_cast({x} as bigint) is not null",
            "double": f"try_cast({x} as double) is not null and not {x} rlike '[dDfF]$'",
            "boolean": f"lower({x}) in ('true', 'false')",
        }
        # Missing cells say nothing about the type.
        fits += [f"bool_and(case when {x} is not null then {test} end) as {t}_{i}" for t, test in tests.items()]
    found = cells.selectExpr(*fits).first()
    order = ("bigint", "double", "boolean")
    return {c: next((t for t in order if found[f"{t}_{i}"]), "string") for i, c in enumerate(cells.columns)}


def work_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share, for tables a job writes and reads back."""
    from tabcast.operators.order import checkpoint_folder

    return f"{checkpoint_folder(spark)}/tabcast-{uuid.uuid4().hex}"


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First ``n`` rows by ``key``; a table has no order of its own."""
    return df.orderBy(key).limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if V.is_number_type(f.dataType)]


def columns_of_type(types: dict[str, str], *wanted: str) -> list[str]:
    return [c for c, t in types.items() if t in wanted]


def select_by_type(df: DataFrame, types: dict[str, str], *wanted: str, keep: tuple = ()) -> DataFrame:
    return df.select(*keep, *[c for c in columns_of_type(types, *wanted) if c not in keep])


def feature_columns(df: DataFrame, types: dict[str, str], target: str) -> list[str]:
    """All columns but the target, identifiers and free text."""
    typed = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    return [c for c in typed if c != target and types.get(c) not in ("identifier", "text")]


def default_target(types: dict[str, str]) -> str | None:
    """Last column that can be predicted."""
    choices = columns_of_type(types, "continuous", "integer", "binary")
    return choices[-1] if choices else None


def default_study(df: DataFrame) -> dict:
    """Default pair, target and features of an association study."""
    numbers = numeric_columns(df)
    if not numbers:
        return {"x": None, "y": None, "target": None, "features": []}
    return {
        "x": numbers[0],
        "y": numbers[1] if len(numbers) > 1 else numbers[0],
        "target": numbers[0],
        "features": numbers[1:],
    }


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)
