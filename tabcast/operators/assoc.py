"""Association of numeric columns: Pearson for all pairs, Spearman, fitted lines."""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.functions import bands, sql, values
from tabcast.operators import comoment, order
from tabcast.operators.linear import t_two_sided
from tabcast.operators.profile import long_form

# Pairs per scan of built-in aggregates: more would outgrow what the JVM compiles.
PAIRS_PER_PASS = 5
# Wider sets of columns go through matrix sums, in one scan.
BUILT_IN_COLUMNS = 8


def pearson(x: str, y: str) -> str:
    """SQL correlation over rows complete in both columns; null when either is constant."""
    pair = f"({sql.name(y)}, {sql.name(x)})"
    sxx = sql.spread(f"regr_sxx{pair}", f"regr_avgx{pair}")
    syy = sql.spread(f"regr_syy{pair}", f"regr_avgy{pair}")
    return f"try_divide(regr_sxy{pair}, sqrt({sxx}) * sqrt({syy}))"


# Rounding may carry |r| past one. ``least`` and ``greatest`` would turn a null into a bound.
WITHIN_ONE = "case when r > 1 then 1D when r < -1 then -1D else r end as r"


def raw_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c1, c2, n, r) for every pair, pairwise complete, unrounded."""
    pairs = list(combinations(columns, 2))
    if len(columns) > BUILT_IN_COLUMNS:
        return _wide_pairs(df, columns)
    result = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        part = long_form(df, [
            sql.struct(c1=sql.text(a), c2=sql.text(b), n=f"regr_count({sql.name(b)}, {sql.name(a)})", r=pearson(a, b))
            for a, b in pairs[start:start + PAIRS_PER_PASS]
        ]).selectExpr("c1", "c2", "n", WITHIN_ONE)
        result = part if result is None else result.unionByName(part)
    return result


def _wide_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs of many columns from matrix sums."""
    names = df.sparkSession.createDataFrame(
        [(i, j, columns[i], columns[j]) for i, j in combinations(range(len(columns)), 2)], "i int, j int, c1 string, c2 string")
    sums = comoment.pair_sums(df, columns, comoment.centres(df, columns))
    result = sums.join(names, ["i", "j"])
    around = {"xx": ("sxx", "sx", "sx"), "yy": ("syy", "sy", "sy"), "xy": ("sxy", "sx", "sy")}
    result = result.selectExpr(
        "c1", "c2", "cast(n as bigint) as n", "sxx", "syy",
        *[f"{s} - try_divide({a} * {b}, n) as {label}" for label, (s, a, b) in around.items()])
    # What is left of a constant after shifting is rounding noise.
    return result.selectExpr(
        "c1", "c2", "n",
        "case when xx > 1e-12 * sxx and yy > 1e-12 * syy then xy / (sqrt(xx) * sqrt(yy)) end as r",
    ).selectExpr("c1", "c2", "n", WITHIN_ONE)


def pearson_pairs(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """All pairs with strength, direction and meaning."""
    size = F.abs("r")
    return raw_pairs(df, columns).select(
        "c1", "c2", "n", F.round("r", digits).alias("r"),
        bands.at_least(size, bands.PAIR_STRENGTH).alias("strength"),
        bands.direction(F.col("r")).alias("direction"),
        bands.at_least(size, bands.PAIR_MEANING).alias("meaning"),
    )


def top_pairs(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """Pairs of the largest |r|."""
    pairs = raw_pairs(df, columns).where("r is not null")
    return pairs.orderBy(F.desc(F.abs("r")), "c1", "c2").limit(k)


def collinear_pairs(df: DataFrame, columns: list[str], limit: float = bands.COLLINEAR_PAIRS) -> DataFrame:
    """Pairs with |r| at or above ``limit``; 0.8 among all columns, 0.7 among the features of a fit."""
    return raw_pairs(df, columns).where(F.abs("r") >= limit)


def pearson_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, r, R2, t, strength and direction of one pair."""
    row = df.agg(F.regr_count(y, x).alias("n"), F.expr(pearson(x, y)).alias("r")).selectExpr("n", WITHIN_ONE)
    r, n = F.col("r"), F.col("n")
    return row.select(
        "n", "r", (r * r).alias("r2"),
        (r * F.sqrt(F.try_divide(n - 2.0, 1 - r * r))).alias("t"),
        bands.at_least(F.abs(r), bands.STUDY_STRENGTH).alias("strength"),
        bands.direction(r).alias("direction"),
    )


def study_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """``pearson_pair`` with its two-sided p-value and Spearman's rho."""
    found = pearson_pair(df, x, y)
    n, t, r = found.select("n", "t", "r").first()
    if t is None:
        p = None if r is None or n <= 2 else 0.0
    else:
        p = t_two_sided(t, n - 2)
    rho = spearman_pair(df, x, y).first()["rho"]
    return found.select(
        "*", F.lit(rho).cast("double").alias("rho"), F.lit(p).cast("double").alias("p"),
        F.lit(None if p is None else p < bands.SIGNIFICANT_P).cast("boolean").alias("significant"),
    )


def average_ranks(df: DataFrame, column: str, small: int = order.BROADCAST_ROWS, weight: str | None = None) -> DataFrame:
    """(value, n, avg_rank): each distinct value once, ties share their mean rank.

    ``weight`` names a column that says how many rows a row stands for.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(n.alias("n"))
    placed = order.running_total(counts, ["value"], F.col("n"), "before", small)
    return placed.select("value", "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def spearman_pair(df: DataFrame, x: str, y: str, small: int = order.BROADCAST_ROWS) -> DataFrame:
    """Spearman's rho over rows complete in both columns, ties by average rank.

    Rows are counted per (x, y) first, and ranks belong to distinct values, so
    repeated values cost one row; the ranks come back by a skew-safe lookup.
    """
    full = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    # Counted once on shared storage: ranks, their sizes and hot values are all sought in these pairs.
    counted = order.materialise(full.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))
    pairs = counted
    for side in ("x", "y"):
        ranks = average_ranks(counted, side, small, "w").select(F.col("value").alias(side), F.col("avg_rank").alias(f"rank_{side}"))
        pairs = order.lookup(pairs, ranks, side, "inner", small)
    middle = ((counted.agg(F.sum("w")).first()[0] or 0) + 1) / 2.0
    a, b, w = F.col("rank_x") - middle, F.col("rank_y") - middle, F.col("w")
    return pairs.agg(
        F.sum("w").alias("n"),
        F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))).alias("rho"),
    )


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares slope and intercept of y on x, with the range of x."""
    full = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    sxx = sql.spread("regr_sxx(y, x)", "avg(x)")
    return full.selectExpr(
        f"try_divide(regr_sxy(y, x), {sxx}) as slope", "avg(x) as x_mean", "avg(y) as y_mean", "min(x) as low", "max(x) as high",
    ).selectExpr("slope", "y_mean - slope * x_mean as intercept", "low", "high")


def line_points(df: DataFrame, x: str, y: str, points: int = 200) -> DataFrame:
    """The fitted line at evenly spaced points."""
    line = fit_line(df, x, y).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = values.linspace(F.col("low"), F.col("high"), F.col("step"), points)
    return line.select("step", at.alias("x"), (F.col("intercept") + F.col("slope") * at).alias("y"))


def zscores(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Columns standardised by the sample deviation; a constant column gives null."""
    wanted = []
    for i, c in enumerate(columns):
        x = sql.name(c)
        wanted += [f"avg({x}) as m{i}", f"sqrt({sql.spread(f'var_samp({x})', f'avg({x})')}) as s{i}"]
    stats = df.selectExpr(*wanted).first()
    return df.select(key, *[
        F.expr(f"try_divide({sql.name(c)} - {sql.number(stats[f'm{i}'])}, {sql.number(stats[f's{i}'])})").alias(c)
        for i, c in enumerate(columns)
    ])
