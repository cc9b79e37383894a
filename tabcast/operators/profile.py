"""Column profiles: moments, quantiles, frequencies, nulls and ranges."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabcast.functions import sql
from tabcast.functions import values as V
from tabcast.operators import order


def long_form(df: DataFrame, structs: list[str]) -> DataFrame:
    """One aggregate row turned into one row per struct."""
    return df.agg(F.expr(f"array({', '.join(structs)})").alias("rows")).select(F.inline("rows"))


def distinct_of(df: DataFrame, column: str) -> str:
    """What to count distinct: long texts stand in by a hash of the whole text."""
    text = df.schema[column].dataType.simpleString() == "string"
    return V.compact(sql.name(column)) if text else sql.name(column)


def count_distinct(df: DataFrame, columns: dict[str, str], exact: bool = True) -> DataFrame:
    """(column, n_unique) of SQL expressions.

    Exact counts take a scan a column, which reads that column alone, drops
    repeats in each task and shuffles what is left of it; counting all columns
    in one scan would copy every row for each column. Persist an input that is
    costly to compute. ``exact=False`` sketches all columns in one scan.
    """
    if not exact:
        return long_form(df, [
            sql.struct(column=sql.text(c), n_unique=f"approx_count_distinct({value})") for c, value in columns.items()
        ])
    result = None
    for c, value in columns.items():
        values = df.selectExpr(f"{value} as value").where("value is not null").distinct()
        part = values.agg(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_unique"))
        result = part if result is None else result.unionByName(part)
    if result is None:
        return df.sparkSession.createDataFrame([], "column string, n_unique bigint")
    return result


# A sketch of 2^14 registers; its estimate deviates by one standard error in this share.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
# The true count is taken to lie within this many standard errors.
SKETCH_MARGIN = 6


def sketched_distinct(value: str) -> str:
    """SQL aggregate that estimates the number of different values; sketches of all tasks are merged."""
    hashed = f"case when ({value}) is not null then xxhash64({value}) end"
    return f"coalesce(hll_sketch_estimate(hll_sketch_agg({hashed}, {SKETCH_BITS})), 0)"


def sketch_interval(estimate: int) -> tuple[int, int]:
    """Least and greatest count that an estimate allows."""
    margin = SKETCH_MARGIN * SKETCH_ERROR * estimate
    return math.ceil(estimate - margin), math.floor(estimate + margin)


def _nulls(column: str) -> str:
    return f"count_if({sql.name(column)} is null)"


def _moments(c: str, digits: int) -> dict[str, str]:
    x = sql.name(c)
    return {
        "mean": f"round(avg({x}), {digits})",
        "std": f"round(stddev_samp({x}), {digits})",
        "min": f"round(cast(min({x}) as double), {digits})",
        "max": f"round(cast(max({x}) as double), {digits})",
    }


def profile_numeric(df: DataFrame, columns: list[str], digits: int = 4, exact: bool = True) -> DataFrame:
    """mean, sample std, min, max, median, distinct and null counts per column."""
    medians = order.quantiles(df, columns, [0.5])
    stats = long_form(df, [
        sql.struct(
            column=sql.text(c), **_moments(c, digits),
            median=f"round({medians[c][0]}, {digits})", nulls=_nulls(c),
        )
        for c in columns
    ])
    return stats.join(count_distinct(df, {c: sql.name(c) for c in columns}, exact), "column")


def describe(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """count, mean, std, min, quartiles and max per column."""
    quartiles = order.quantiles(df, columns, [0.25, 0.5, 0.75])
    return long_form(df, [
        sql.struct(
            column=sql.text(c), n=f"count({sql.name(c)})", **_moments(c, digits),
            **{label: f"round({q}, {digits})" for label, q in zip(("q25", "q50", "q75"), quartiles[c])},
        )
        for c in columns
    ])


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    return count_distinct(df, {c: distinct_of(df, c) for c in columns}, exact)


def null_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of nulls in percent, to one decimal."""
    return long_form(df, [
        sql.struct(column=sql.text(c), null_percent=f"round(100D * avg(cast({sql.name(c)} is null as double)), 1)")
        for c in columns
    ])


def value_frequencies(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by.., column, value, n) for all columns in one pass; hot values combine before the shuffle."""
    by = by or []
    cells = df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns if c not in by])
    long = cells.unpivot(by, [c for c in columns if c not in by], "column", "value")
    return long.where("value is not null").groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each column, ties by value, with their place."""
    best_first = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        value_frequencies(df, columns)
        .withColumn("place", F.row_number().over(best_first))
        .where(F.col("place") <= k)
    )


def value_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of one column."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def modes(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Most frequent value per column as text, the smallest on ties.

    Two partial aggregates: no task ever holds all values of a column.
    """
    first = F.min_by("value", F.struct((-F.col("n")).alias("less"), F.col("value")))
    return value_frequencies(df, columns, by).groupBy(*(by or []), "column").agg(first.alias("mode"), F.max("n").alias("n"))


def profile_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct and null counts with the three most frequent values."""
    nulls = long_form(df, [sql.struct(column=sql.text(c), nulls=_nulls(c)) for c in columns])
    places = [F.max(F.when(F.col("place") == i, F.col("value"))).alias(f"top{i}") for i in (1, 2, 3)]
    best = top_values(df, columns, 3).groupBy("column").agg(*places)
    return nulls.join(distinct_counts(df, columns), "column").join(best, "column", "left")


def choices(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """First ``k`` distinct values in order, as offered for a scenario."""
    return df.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value").limit(k)


def range_defaults(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Default sweep range of each column."""
    return long_form(df, [
        sql.struct(
            column=sql.text(c),
            low=f"round(cast(min({sql.name(c)}) as double), {digits})",
            high=f"round(cast(max({sql.name(c)}) as double), {digits})",
        )
        for c in columns
    ])


def time_series(df: DataFrame, date_column: str, value_column: str, key: str | None = None) -> DataFrame:
    """Dated values in time order, rows without a readable date or value left out."""
    stamp = V.as_timestamp(F.col(date_column), df.schema[date_column].dataType)
    keep = [F.col(key)] if key else []
    rows = df.select(*keep, stamp.alias("at"), F.col(value_column).alias("value")).dropna(subset=["at", "value"])
    return rows.orderBy("at", *([key] if key else []))
