"""Scenario tables: baselines, what-ifs, sweeps and projections, and their scores.

Grids come from ``explode(sequence)`` on the baseline rows, one baseline per
group, so a projection for every customer is the same job as one for all.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcast.functions import bands, values
from tabcast.functions.words import DAY_NAMES, MONTH_NAMES, YEAR_NAMES
from tabcast.operators import order
from tabcast.operators.profile import modes

Z_95 = 1.96


def baseline(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """One row (per group): mean of numbers, most frequent value of the rest."""
    groups = list(by or ["_all"])
    rows = df if by else df.withColumn("_all", F.lit(1))
    features = [c for c in features if c not in groups]
    numbers = [c for c in features if values.is_number_type(df.schema[c].dataType)]
    others = [c for c in features if c not in numbers]
    result = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in numbers])
    if others:
        wide = [
            F.max(F.when(F.col("column") == c, F.col("mode"))).cast(df.schema[c].dataType).alias(c) for c in others
        ]
        usual = modes(rows, others, groups).groupBy(*groups).agg(*wide)
        usual = usual.select(*[F.col(g).alias(f"_g_{g}") for g in groups], *others)
        match = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
        result = result.join(usual, match, "left").drop(*[f"_g_{g}" for g in groups])
    return result.select(*(by or []), "n_rows", *features)


def what_if(base: DataFrame, overrides: DataFrame, by: str | None = None) -> DataFrame:
    """Overrides completed from the baseline; one baseline row serves all, or the row of the same ``by``."""
    features = [c for c in base.columns if c not in (by, "n_rows")]
    given = [c for c in features if c in overrides.columns]
    own = [c for c in overrides.columns if c not in given]
    if by is None:
        row = base.first()
        usual = {c: order.typed_literal(row[c], base.schema[c].dataType) for c in features}
        rows = overrides
    else:
        usual = {c: F.col(f"_base_{c}") for c in features}
        side = base.select(by, *[F.col(c).alias(f"_base_{c}") for c in features])
        rows = order.lookup(overrides, side, by)
    return rows.select(*own, *[F.coalesce(F.col(c), usual[c]).alias(c) if c in given else usual[c].alias(c) for c in features])


def sweep(base: DataFrame, column: str, low, high, steps: int = 50) -> DataFrame:
    """Each baseline row repeated over evenly spaced values of one feature.

    ``low`` and ``high`` are numbers or columns of the baseline.
    """
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    rows = base.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return rows.withColumn(column, values.linspace(low, high, F.col("step"), steps))


def future_dates(base: DataFrame, start: Column, n: int = 12, unit: str = "month", calendar: bool = False) -> DataFrame:
    """Each baseline row repeated for periods 1..n after ``start``, with the date as text."""
    rows = base.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    at = values.shift_periods(start, F.col("step"), unit, calendar)
    return rows.withColumn("at", F.date_format(at, "yyyy-MM-dd"))


def project(
    base: DataFrame, types: dict[str, str], start: Column, n: int = 12, unit: str = "month", calendar: bool = False,
) -> DataFrame:
    """Future scenarios: date features and year, month and day columns follow the calendar."""
    rows = future_dates(base, start, n, unit, calendar)
    at = F.to_date("at")
    changes = {}
    for c in base.columns:
        if types.get(c) == "date":
            changes[c] = at.cast("timestamp_ntz")
        elif c.lower() in YEAR_NAMES:
            changes[c] = F.year(at)
        elif c.lower() in MONTH_NAMES:
            changes[c] = F.month(at)
        elif c.lower() in DAY_NAMES:
            changes[c] = F.dayofmonth(at)
    return rows.withColumns(changes) if changes else rows


def rmse_interval(df: DataFrame, rmse: float | Column, z: float = Z_95, pred: str = "pred") -> DataFrame:
    """Add ``ci_low`` and ``ci_high`` at ``z`` root mean squared errors."""
    reach = (rmse if isinstance(rmse, Column) else F.lit(float(rmse))) * F.lit(z)
    return df.withColumns({"ci_low": F.col(pred) - reach, "ci_high": F.col(pred) + reach})


def interval_bands(df: DataFrame, rmse: float, y_range: float) -> DataFrame:
    """Add the width in percent of the prediction, its band, and whether the RMSE is small for the target."""
    whole = F.when(F.col("pred") != 0, F.col("pred")).otherwise(1.0)
    percent = (F.col("ci_high") - F.col("ci_low")) / whole * 100
    return df.withColumns({
        "width_percent": percent,
        "precision": bands.below(percent, bands.INTERVAL_SHARE),
        "reliable": F.lit(rmse < bands.RELIABLE_RMSE_SHARE * y_range),
    })


def sweep_trend(scored: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """Slope between the ends of a sweep, and its sign in words."""
    ends = scored.groupBy(*(by or [])).agg(
        F.min_by(x, "step").alias("x_first"), F.max_by(x, "step").alias("x_last"),
        F.min_by("pred", "step").alias("pred_first"), F.max_by("pred", "step").alias("pred_last"),
    )
    slope = F.coalesce(
        F.try_divide(F.col("pred_last") - F.col("pred_first"), F.col("x_last") - F.col("x_first")), F.lit(0.0),
    )
    return ends.withColumn("slope", slope).withColumn("trend", bands.trend(F.col("slope")))


def projection_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First, last, largest and smallest prediction of a projection, and the change."""
    found = scored.groupBy(*(by or [])).agg(
        F.min_by("pred", "step").alias("first"), F.max_by("pred", "step").alias("last"),
        F.max("pred").alias("highest"), F.min("pred").alias("lowest"),
    )
    change = F.col("last") - F.col("first")
    return found.withColumn("change", change).withColumn("movement", F.when(change > 0, "increase").otherwise("decrease"))


def with_history(history: DataFrame, projected: DataFrame) -> DataFrame:
    """Past values and projected ones as one series: kind, at, value, ci_low, ci_high."""
    past = history.select(
        F.lit("history").alias("kind"), F.date_format("at", "yyyy-MM-dd").alias("at"),
        F.col("value").cast("double").alias("value"),
        F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"),
    )
    future = projected.select(F.lit("projection").alias("kind"), "at", F.col("pred").alias("value"), "ci_low", "ci_high")
    return past.unionByName(future)
