"""Train/test split, contiguous folds and prediction metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcast.functions import bands, sql, values
from tabcast.operators import order

# Fixed values of the split: a multiplicative hash modulo a Mersenne prime.
SPLIT_FACTOR = 48271
SPLIT_PRIME = 2147483647


def in_test(key: Column, test: float = 0.2, seed: int = 42) -> Column:
    """True for the rows held out, decided by the key alone, so by no partitioning."""
    mixed = F.pmod(F.pmod(key, F.lit(SPLIT_PRIME)) * F.lit(SPLIT_FACTOR) + F.lit(seed), F.lit(SPLIT_PRIME))
    return mixed % 1000 < F.lit(round(1000 * test))


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``; keys that are not whole numbers are hashed first."""
    whole = values.is_integer_type(df.schema[key].dataType)
    number = F.col(key).cast("bigint") if whole else F.xxhash64(key)
    return df.withColumn("is_test", in_test(number, test, seed))


def split_counts(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    return split(df, key, test, seed).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


def kfold(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Add ``fold``: k runs of rows contiguous by a unique key, longer ones first.

    Only the k-1 keys at which folds begin are looked up; rows are not moved.
    """
    n = df.count()
    starts, at = [], 0
    for fold in range(k - 1):
        at += n // k + (1 if fold < n % k else 0)
        starts.append(at)
    dtype = df.schema[key].dataType
    edges = order.values_at(df, key, [s for s in starts if s < n])
    fold = F.lit(0)
    for edge in edges:
        fold = fold + (F.col(key) >= order.typed_literal(edge, dtype)).cast("int")
    return df.withColumn("fold", fold)


def metric_columns(y: str, pred: str) -> dict[str, Column]:
    """R2, MSE, MAE and RMSE as aggregates."""
    error = F.col(y) - F.col(pred)
    mse = F.avg(error * error)
    return {
        "r2": 1 - F.try_divide(mse, F.expr(sql.spread(f"var_pop({sql.name(y)})", f"avg({sql.name(y)})"))),
        "mse": mse,
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(mse),
    }


def metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row with all metrics from one pass."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in metric_columns(y, pred).items()])


def metrics_banded(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Metrics with the quality of R2, the overfit note and the size of the error."""
    found = metric_columns(y, pred)
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in found.items()],
        (F.max(y) - F.min(y)).alias("y_range"),
    )
    share = F.when(F.col("y_range") > 0, F.col("mae") / F.col("y_range") * 100).otherwise(0.0)
    return row.withColumn("mae_percent", share).withColumns({
        "quality": bands.at_least(F.col("r2"), bands.R2_QUALITY),
        "overfit_note": F.coalesce(F.col("r2") >= bands.OVERFIT_R2, F.lit(False)),
        "mae_band": bands.below(F.col("mae_percent"), bands.MAE_SHARE),
    })


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores, and whether they are stable."""
    return scores.agg(
        F.count("r2").alias("folds"), F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
    ).withColumn("stable", F.col("cv_r2_std") < bands.STABLE_CV_STD)
