"""What the errors of a model look like."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcast.functions import bands
from tabcast.operators import order


def residuals(df: DataFrame, y: str, pred: str, keep: tuple = ()) -> DataFrame:
    """Residual, its size, and whether it lies within one deviation."""
    error = F.col(y) - F.col(pred)
    std = df.agg(F.stddev_pop(error)).first()[0]
    return df.select(
        *keep, F.col(y).alias("y"), F.col(pred).alias("pred"), error.alias("residual"),
        F.abs(error).alias("abs_residual"), (F.abs(error) <= F.lit(std).cast("double")).alias("in_band"),
    )


def pred_extent(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Common range of actual and predicted values."""
    return df.agg(F.least(F.min(y), F.min(pred)).alias("low"), F.greatest(F.max(y), F.max(pred)).alias("high"))


def lower_half(df: DataFrame, value: str, key: str) -> Column:
    """True for the first floor(n/2) rows by (value, key).

    The middle value, and among its ties the middle key, are found exactly;
    no table is sorted and no row moves.
    """
    half = df.count() // 2
    if half == 0:
        return F.lit(False)
    value_type, key_type = df.schema[value].dataType, df.schema[key].dataType
    [(found, under)] = order.select_ranks(df, {value: [half - 1]})[value]
    edge = order.typed_literal(found, value_type)
    ties = df.where(F.col(value) == edge)
    last = order.typed_literal(order.values_at(ties, key, [half - under - 1])[0], key_type)
    return (F.col(value) < edge) | ((F.col(value) == edge) & (F.col(key) <= last))


def half_spread(df: DataFrame, residual: str, pred: str, key: str) -> DataFrame:
    """One row: population deviation of the residual in the lower and upper half of predictions."""
    lower = lower_half(df, pred, key)
    row = df.agg(
        F.count_if(lower).alias("n_low"), F.count_if(~lower).alias("n_high"),
        F.stddev_pop(F.when(lower, F.col(residual))).alias("std_low"),
        F.stddev_pop(F.when(~lower, F.col(residual))).alias("std_high"),
    )
    ratio = F.when(F.col("std_low") > 0, F.col("std_high") / F.col("std_low")).otherwise(1.0)
    return row.withColumn("ratio", ratio)


def residual_report(df: DataFrame, y: str, pred: str, key: str) -> DataFrame:
    """One row: bias, equal spread, outliers and share within one deviation, each with its verdict."""
    rows = df.select(key, F.col(pred).cast("double").alias("pred"), (F.col(y) - F.col(pred)).alias("residual"))
    mean, std = rows.agg(F.avg("residual"), F.stddev_pop("residual")).first()
    lower = lower_half(rows, "pred", key)
    e, m, s = F.col("residual"), F.lit(mean).cast("double"), F.lit(std).cast("double")
    row = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_pop(F.when(lower, e)).alias("_low"), F.stddev_pop(F.when(~lower, e)).alias("_high"),
        F.count_if(F.abs(F.try_divide(e - m, s)) > 3).alias("n_outliers"),
        (F.lit(100.0) * F.avg((F.abs(e) <= s).cast("double"))).alias("within_1s_percent"),
    )
    ratio = F.when(F.col("_low") > 0, F.col("_high") / F.col("_low")).otherwise(1.0)
    bias = F.when(F.abs(m) < 0.05 * s, "none").when(m < 0, "over").otherwise("under")
    return row.select(
        "n", m.alias("mean"), s.alias("std"), bias.alias("bias"), ratio.alias("spread_ratio"),
        F.when(ratio < 1.5, "equal").otherwise("unequal").alias("spread"), "n_outliers", "within_1s_percent",
        F.when(F.col("within_1s_percent") >= 65, "near_normal").otherwise("irregular").alias("form"),
    )


def scatter_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: median error as a share of the range, and systematic bias."""
    rows = df.select(F.col(y).alias("y"), (F.col(pred) - F.col(y)).alias("gap"), F.abs(F.col(pred) - F.col(y)).alias("size"))
    median = order.quantiles(rows, ["size"], [0.5])["size"][0]
    row = rows.agg(F.expr(median).alias("median_error"), F.avg("gap").alias("bias"), (F.max("y") - F.min("y")).alias("y_range"))
    share = F.when(F.col("y_range") > 0, F.col("median_error") / F.col("y_range") * 100).otherwise(0.0)
    side = (
        F.when(F.abs("bias") < 0.02 * F.col("y_range"), "none").when(F.col("bias") > 0, "over").otherwise("under")
    )
    return row.select(
        "median_error", share.alias("median_percent"), bands.below(share, bands.ERROR_SHARE).alias("fit"),
        "bias", side.alias("bias_side"),
    )
