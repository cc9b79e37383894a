"""Least squares from merged triangles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabcast.operators import linear, tsqr


def design(spark, columns, y, parts):
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(np.column_stack(columns), y))]
    names = ", ".join(f"x{i} double" for i in range(len(columns)))
    return spark.createDataFrame(rows, f"id long, {names}, y double").repartition(parts)


def want(columns, y):
    a = np.column_stack([np.ones(len(y)), *columns])
    scale = np.abs(a).max(axis=0)
    coef, *_ = np.linalg.lstsq(a / scale, y, rcond=None)
    left = y - a / scale @ coef
    # Rows of the inverse triangle: the inverse of the cross products would lose half of the digits itself.
    back = np.linalg.inv(np.linalg.qr(a / scale, mode="r"))
    return coef / scale, np.sqrt((back * back).sum(axis=1) * (left @ left) / (len(y) - a.shape[1])) / scale, left


@pytest.mark.parametrize(("parts", "fanout"), [(1, 32), (9, 2), (40, 3)])
def test_triangle(spark, parts, fanout, monkeypatch):
    monkeypatch.setattr(tsqr, "FANOUT", fanout)
    rng = np.random.default_rng(parts)
    columns = [rng.standard_normal(700), rng.uniform(5, 6, 700)]
    n, r = tsqr.triangle(design(spark, columns, columns[0], parts), ["x0", "x1"])
    a = np.column_stack([np.ones(700), *columns])
    assert n == 700 and np.allclose(np.tril(r, -1), 0) and np.allclose(r.T @ r, a.T @ a)


def test_badly_scaled_and_nearly_collinear(spark):
    """Condition 1e7 and scales from 1e-6 to 1e9: normal equations lose all but a few digits here."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal(3000)
    columns = [a * 1e9 + 5e9, a + 1e-6 * rng.standard_normal(3000), rng.uniform(0, 1e-6, 3000), rng.integers(0, 9, 3000) + 1e6]
    y = 2e-9 * columns[0] + 3 * columns[1] + 4e6 * columns[2] - 0.5 * columns[3] + 0.01 * rng.standard_normal(3000)
    terms, whole = linear.ols(design(spark, columns, y, 7), "y", ["x0", "x1", "x2", "x3"])
    got = terms.collect()
    coef, se, left = want(columns, y)
    assert np.allclose([r["coef"] for r in got], coef, rtol=1e-8) and np.allclose([r["std_error"] for r in got], se, rtol=1e-6)
    row = whole.first()
    assert row["n"] == 3000 and abs(row["r2"] - (1 - left @ left / ((y - y.mean()) @ (y - y.mean())))) < 1e-8


def test_constant_repeated_and_few(spark):
    """A constant and a repeated column lower the rank; nulls drop rows; too few rows leave no error."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal(200)
    y = 1 + 2 * x + rng.standard_normal(200)
    df = design(spark, [x, x, np.full(200, 1e6 / 3)], y, 3)
    terms, whole = linear.ols(df, "y", ["x0", "x1", "x2"])
    coef = [r["coef"] for r in terms.collect()]
    slope = np.polyfit(x, y, 1)
    assert abs(coef[1] + coef[2] - slope[0]) < 1e-9 and coef[3] == 0 and abs(whole.first()["r2"] - np.corrcoef(x, y)[0, 1] ** 2) < 1e-9
    holes = df.withColumn("x0", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("x0")))
    assert linear.ols(holes, "y", ["x0"])[1].first()["n"] == 150
    assert linear.ols(df.limit(2), "y", ["x0"])[1].first()["n"] == 2
    assert linear.ols(df.limit(0), "y", ["x0"])[1].first()["n"] == 0
