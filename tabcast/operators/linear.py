"""Linear models from centred moments, with classical inference.

The table is read into counts, means and covariances (per fold when
cross-validating). What is solved on the driver
has the size of the feature list, not of the table.
"""

import math
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcast.functions import bands
from tabcast.operators import comoment, tsqr

# Moments per scan of built-in aggregates: more would outgrow what the JVM compiles.
MOMENTS_PER_PASS = 25
# Wider models take matrix sums, in one scan.
BUILT_IN_COLUMNS = 8
# More features than this go to the solver of Spark ML.
MAX_FEATURES = 255


@dataclass
class Moments:
    """n, means and co-moments (sums of centred products); the target comes last."""

    n: int
    mean: np.ndarray
    co: np.ndarray

    def merged(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        if n == 0:
            return self
        gap = other.mean - self.mean
        mean = self.mean + gap * (other.n / n)
        co = self.co + other.co + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, mean, co)


@dataclass
class LinearFit:
    features: list[str]
    coef: np.ndarray
    intercept: float
    moments: Moments

    def rounded(self, digits: int) -> "LinearFit":
        """The same model with its numbers rounded, as when they are published."""
        return LinearFit(self.features, np.round(self.coef, digits), round(self.intercept, digits), self.moments)

    def predict(self) -> Column:
        """Prediction as column arithmetic."""
        value = F.lit(float(self.intercept))
        for name, weight in zip(self.features, self.coef):
            value = value + F.lit(float(weight)) * F.col(name)
        return value


def moments(df: DataFrame, features: list[str], target: str, by: str | None = None) -> dict:
    """Moments of complete rows, one entry per value of ``by`` (or under None)."""
    names = [*features, target]
    keep = [by] if by else []
    rows = df.select(*keep, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]).dropna()
    size = len(names)
    if size > BUILT_IN_COLUMNS:
        return _wide_moments(rows, size, by)
    wanted = [F.expr(f"avg(v{i}) as m{i}") for i in range(size)]
    wanted += [F.expr(f"covar_pop(v{i}, v{j}) as c{i}_{j}") for i, j in combinations_with_replacement(range(size), 2)]
    gathered: dict = {}
    for start in range(0, len(wanted), MOMENTS_PER_PASS):
        batch = wanted[start:start + MOMENTS_PER_PASS]
        for row in rows.groupBy(*keep).agg(F.count(F.lit(1)).alias("n"), *batch).collect():
            gathered.setdefault(row[by] if by else None, {}).update(row.asDict())
    return {key: _as_moments(got, size) for key, got in gathered.items()}


def _wide_moments(rows: DataFrame, size: int, by: str | None) -> dict:
    columns = [f"v{i}" for i in range(size)]
    centre = np.array(comoment.centres(rows, columns))
    found: dict = {}
    for row in comoment.pair_sums(rows, columns, centre.tolist(), by).collect():
        key = row["key"] if by else None
        m = found.setdefault(key, Moments(0, np.zeros(size), np.zeros((size, size))))
        i, j, n = row["i"], row["j"], row["n"]
        m.n = int(n)
        m.mean[i], m.mean[j] = centre[i] + row["sx"] / n, centre[j] + row["sy"] / n
        m.co[i, j] = m.co[j, i] = row["sxy"] - row["sx"] * row["sy"] / n
    return {key: _settled(m) for key, m in found.items()} or {None: Moments(0, np.zeros(size), np.zeros((size, size)))}


def _as_moments(got: dict, size: int) -> Moments:
    n = got["n"]
    if n == 0:
        return Moments(0, np.zeros(size), np.zeros((size, size)))
    co = np.zeros((size, size))
    for i, j in combinations_with_replacement(range(size), 2):
        co[i, j] = co[j, i] = n * got[f"c{i}_{j}"]
    return _settled(Moments(n, np.array([got[f"m{i}"] for i in range(size)]), co))


def _settled(m: Moments) -> Moments:
    """Co-moments of columns that only rounding keeps from being constant become zero."""
    moving = np.diag(m.co) > 1e-24 * m.n * m.mean * m.mean
    m.co[~moving, :] = 0.0
    m.co[:, ~moving] = 0.0
    return m


def _inverse(co: np.ndarray) -> np.ndarray:
    """Pseudo-inverse taken on the correlation scale, so units do not matter."""
    scale = np.sqrt(np.diag(co))
    safe = np.where(scale > 0, scale, 1.0)
    inverse = np.linalg.pinv(co / np.outer(safe, safe), rcond=1e-12, hermitian=True)
    return np.where(np.outer(scale > 0, scale > 0), inverse, 0.0) / np.outer(safe, safe)


def solve(m: Moments, features: list[str], alpha: float = 0.0) -> LinearFit:
    """Least squares, or ridge with penalty ``alpha`` on the squared coefficients."""
    xx, xy = m.co[:-1, :-1], m.co[:-1, -1]
    coef = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy) if alpha > 0 else _inverse(xx) @ xy
    return LinearFit(features, coef, float(m.mean[-1] - coef @ m.mean[:-1]), m)


def squared_error(fit: LinearFit, m: Moments) -> float:
    """Sum of squared errors of a fit on the rows behind ``m``."""
    b = fit.coef
    around = m.co[-1, -1] - 2 * b @ m.co[:-1, -1] + b @ m.co[:-1, :-1] @ b
    shift = m.mean[-1] - fit.intercept - b @ m.mean[:-1]
    return float(max(around, 0.0) + m.n * shift * shift)


def fit_linear(df: DataFrame, features: list[str], target: str, alpha: float = 0.0) -> LinearFit:
    """Ordinary (``alpha=0``) or ridge regression on complete rows."""
    if target in features:
        raise ValueError(f"target {target} is among the features")
    if len(features) > MAX_FEATURES:
        return _fit_wide(df, features, target, alpha)
    return solve(moments(df, features, target)[None], features, alpha)


def _fit_wide(df: DataFrame, features: list[str], target: str, alpha: float) -> LinearFit:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in [*features, target]]).dropna()
    n, spread, mean = rows.agg(F.count(F.lit(1)), F.stddev_pop(target), F.avg(target)).first()
    vectors = VectorAssembler(inputCols=features, outputCol="_features").transform(rows)
    # Spark ML divides the error by n and scales the penalty by the target's deviation.
    penalty = alpha / n * spread if alpha else 0.0
    model = LinearRegression(
        featuresCol="_features", labelCol=target, regParam=penalty, standardization=False,
        solver="normal" if len(features) <= 4096 else "l-bfgs",
    ).fit(vectors)
    blank = Moments(n, np.append(np.zeros(len(features)), mean), np.zeros((len(features) + 1,) * 2))
    return LinearFit(features, model.coefficients.toArray(), float(model.intercept), blank)


def coefficients(spark, fit: LinearFit) -> DataFrame:
    """(term, coef), the constant under ``const``."""
    rows = [("const", float(fit.intercept)), *[(f, float(c)) for f, c in zip(fit.features, fit.coef)]]
    return spark.createDataFrame(rows, "term string, coef double")


def cross_validate(df: DataFrame, features: list[str], target: str, fold: str, alpha: float = 0.0) -> DataFrame:
    """(fold, n, r2) on each held-out fold, all folds from one grouped pass."""
    folds = moments(df, features, target, by=fold)
    rows = []
    for held, inside in sorted(folds.items()):
        rest = [m for key, m in folds.items() if key != held]
        trained = rest[0]
        for m in rest[1:]:
            trained = trained.merged(m)
        error = squared_error(solve(trained, features, alpha), inside)
        spread = float(inside.co[-1, -1])
        rows.append((int(held), int(inside.n), 1 - error / spread if spread > 0 else None))
    return df.sparkSession.createDataFrame(rows, "fold int, n bigint, r2 double")


# A column is constant if its deviations are below this share of its size; a direction is dropped below this share of the largest.
CONSTANT_SHARE = 1e-12
RANK_SHARE = 1e-9


def _solved(n: int, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float, float]:
    """Coefficients behind the constant, inverse of the centred cross products, rank, squared error and spread of the target."""
    inner, target = r[1:-1, 1:-1], r[1:-1, -1]
    scale = np.sqrt((inner * inner).sum(axis=0))
    moving = scale > CONSTANT_SHARE * np.abs(r[0, 1:-1])
    scale = np.where(moving, scale, 1.0)
    u, share, v = np.linalg.svd(np.where(moving, inner, 0.0) / scale)
    kept = share > RANK_SHARE * max(share.max(initial=0.0), 1e-300)
    back = np.where(kept, 1 / np.where(kept, share, 1.0), 0.0)
    coef = (v.T * back) @ (u.T @ target) / scale
    inverse = (v.T * back**2) @ v / np.outer(scale, scale)
    left = target - np.where(moving, inner, 0.0) @ coef
    return coef, inverse, int(kept.sum()), float(left @ left + r[-1, -1] ** 2), float(r[1:, -1] @ r[1:, -1])


def ols(df: DataFrame, target: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Term table (coef, std error, t, p, E-value, tier) and one-row fit table, from the triangle of all columns."""
    if target in features:
        raise ValueError(f"target {target} is among the features")
    spark = df.sparkSession
    n, r = tsqr.triangle(df, [*features, target])
    coef, inverse, rank, error, total = _solved(n, r)
    means = r[0, 1:] / r[0, 0] if n else np.full(len(features) + 1, math.nan)
    fit = LinearFit(features, coef, float(means[-1] - coef @ means[:-1]), Moments(n, means, np.zeros((len(means),) * 2)))
    m = fit.moments
    free = n - rank - 1
    variance = error / free if free > 0 else math.nan
    mean = means[:-1]
    spread = [1 / n + float(mean @ inverse @ mean) if n else math.nan, *np.diag(inverse).tolist()]
    terms = []
    for name, coef, share in zip(["const", *features], [fit.intercept, *fit.coef.tolist()], spread):
        se = math.sqrt(variance * share) if variance * share >= 0 else math.nan
        t = coef / se if se > 0 else math.nan
        p = t_two_sided(t, free)
        terms.append((name, coef, se, t, p, 1 - p))
    table = spark.createDataFrame(terms, "term string, coef double, std_error double, t double, p double, e_value double")
    table = table.withColumn("tier", F.when(F.col("term") != "const", bands.below(F.col("p"), bands.P_TIER)))
    r2 = 1 - error / total if total > 0 else math.nan
    f_value = (total - error) / rank / variance if rank and variance > 0 else math.nan
    loglik = -m.n / 2 * (math.log(2 * math.pi * error / m.n) + 1) if error > 0 else math.inf
    whole = spark.createDataFrame(
        [(m.n, r2, 1 - (1 - r2) * (m.n - 1) / free if free > 0 else math.nan, f_value,
          f_tail(f_value, rank, free), -2 * loglik + 2 * (rank + 1))],
        "n bigint, r2 double, r2_adjusted double, f double, f_p double, aic double",
    )
    return table, whole


def tiers(table: DataFrame) -> DataFrame:
    """Terms by significance; the constant has none."""
    return table.where(F.col("term") != "const").select("tier", "term", "p")


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for k in range(1, 10_000):
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        for step in (even, odd):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, free: float) -> float:
    """Two-sided p-value of a t statistic."""
    if t != t or free <= 0:
        return math.nan
    return _beta_share(free / 2, 0.5, free / (free + t * t))


def f_tail(f: float, above: float, below: float) -> float:
    """Upper tail of an F statistic."""
    if f != f or above <= 0 or below <= 0:
        return math.nan
    return _beta_share(below / 2, above / 2, below / (below + above * f))
