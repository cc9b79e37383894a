"""Order statistics, running totals and lookups on their small and their large path."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabcast.operators import assoc, diagnose, evaluate, order


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows hold one value; the rest are spread over many scales."""
    rng = random.Random(7)
    rows = [(i, 5.0 if i % 3 == 0 else round(rng.gauss(0, 1) * 10 ** (i % 6), 3)) for i in range(6000)]
    return spark.createDataFrame(rows, "id bigint, x double").repartition(7).cache()


@pytest.mark.parametrize("small", [10, 200, 1_000_000])
def test_values_at(skewed, small):
    ordered = sorted(r["x"] for r in skewed.collect())
    places = [0, 1, 2999, 3000, 4500, 5998, 5999]
    assert order.values_at(skewed, "x", places, small) == [ordered[p] for p in places]


def test_values_at_two_heavy_values(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 500 + [2.0] * 500 + [1.5]], "x double")
    assert order.values_at(df, "x", [499, 500, 501], small=5) == [1.0, 1.5, 2.0]


def test_values_at_dates_and_large_integers(spark):
    df = spark.range(1000).selectExpr("id + 9007199254740993 as k", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,cast(id as int)) as t")
    assert order.values_at(df, "k", [1, 998], small=10) == [9007199254740994, 9007199254741991]
    assert str(order.values_at(df, "t", [31], small=10)[0]) == "2024-02-01 00:00:00"
    with pytest.raises(IndexError):
        order.values_at(df, "k", [1000])


@pytest.mark.parametrize("small", [50, 1_000_000])
def test_quantiles(skewed, small):
    x = np.array([r["x"] for r in skewed.collect()])
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = order.quantiles(skewed, ["x"], shares, small)["x"]
    row = skewed.selectExpr(*[f"{q} as q{i}" for i, q in enumerate(found)] if small > 50 else [f"max({q}) as q{i}" for i, q in enumerate(found)]).first()
    assert np.allclose(list(row), np.quantile(x, shares))


@pytest.mark.parametrize("small", [100, 1_000_000])
def test_running_total(skewed, small):
    counts = skewed.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = {r["x"]: r["before"] for r in order.running_total(counts, ["x"], F.col("n"), "before", small).collect()}
    values = np.sort([r["x"] for r in skewed.collect()])
    assert got == {v: int(np.searchsorted(values, v)) for v in set(values.tolist())}


@pytest.mark.parametrize("small", [3, 1_000_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_with_a_hot_key(spark, small, how):
    keys = [0] * 4000 + [None] * 50 + [i % 90 for i in range(3000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id int, k int")
    table = spark.createDataFrame([(i, f"v{i}") for i in range(0, 80)], "k int, v string")
    got = {(r["id"], r["k"], r["v"]) for r in order.lookup(rows, table, "k", how, small).collect()}
    want = {(i, k, f"v{k}" if k is not None and k < 80 else None) for i, k in enumerate(keys)}
    assert got == (want if how == "left" else {w for w in want if w[2]})


def test_folds_are_contiguous_and_even(spark):
    df = spark.range(1003).select((F.col("id") * 7 + 3).alias("k")).repartition(5)
    got = sorted((r["k"], r["fold"]) for r in evaluate.kfold(df, "k", 5).collect())
    folds = [f for _, f in got]
    assert folds == sorted(folds)
    assert [folds.count(i) for i in range(5)] == [201, 201, 201, 200, 200]


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r["k"] for r in evaluate.split(df.repartition(3), "k").where("is_test").collect()}
    b = {r["k"] for r in evaluate.split(df.repartition(11), "k").where("is_test").collect()}
    assert a == b and 850 < len(a) < 1150


def test_lower_half_cuts_ties_by_key(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 5 else float(i % 2)) for i in range(11)], "id bigint, p double")
    lower = sorted(r["id"] for r in df.where(diagnose.lower_half(df, "p", "id")).collect())
    want = sorted(i for _, i in sorted((r["p"], r["id"]) for r in df.collect())[:5])
    assert lower == want


@pytest.mark.parametrize("small", [20, 1_000_000])
def test_spearman_with_ties_and_nulls(spark, small):
    import pandas as pd

    rng = random.Random(3)
    rows = [(None if i % 13 == 0 else float(rng.randint(0, 40)), None if i % 17 == 0 else (1.0 if i % 3 else float(rng.randint(0, 300)))) for i in range(900)]
    frame = pd.DataFrame(rows, columns=["a", "b"]).dropna()
    want = frame["a"].rank().corr(frame["b"].rank())
    got = assoc.spearman_pair(spark.createDataFrame(rows, "a double, b double"), "a", "b", small).first()
    assert got["n"] == len(frame) and abs(got["rho"] - want) < 1e-9


def jobs_of(spark, name, run):
    """The value of ``run`` and the number of Spark jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        value = run()
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    return value, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.fixture(scope="module")
def mixed(spark):
    """Columns of many types with nulls, ties, a hot value and extremes."""
    rng = random.Random(11)
    rows = []
    for i in range(5000):
        x = None if i % 7 == 0 else 2.5 if i % 3 == 0 else rng.gauss(0, 1) * 10 ** (i % 5)
        rows.append((i, x, rng.randint(0, 9), rng.choice([-(2**62), 2**62 - 3, 2**62 - 2, 5, None]), f"{rng.randint(1, 10**6)}.{rng.randint(0, 99):02d}", rng.randint(0, 4000), None))
    df = spark.createDataFrame(rows, "id long, x double, few int, `far out` long, money string, day int, gone double")
    return df.selectExpr(
        "id", "x", "few", "`far out`", "cast(money as decimal(12,2)) as money", "date_add(date'2000-01-01', day) as day",
        "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, 0, 0, day) as at", "gone",
    ).repartition(6).cache()


@pytest.mark.parametrize("small", [1, 40, 700, 1_000_000])
def test_select_ranks_of_many_columns(mixed, small):
    rows = mixed.collect()
    wanted, want = {}, {}
    for c in mixed.columns[:-1]:
        ordered = sorted(r[c] for r in rows if r[c] is not None)
        places = sorted({0, 1, len(ordered) // 4, len(ordered) // 2, len(ordered) // 2 + 1, len(ordered) - 1})
        wanted[c] = places
        want[c] = [(ordered[p], sum(v < ordered[p] for v in ordered)) for p in places]
    assert order.select_ranks(mixed, wanted, small) == want
    with pytest.raises(IndexError):
        order.select_ranks(mixed, {"gone": [0]}, small)
    assert order.select_ranks(mixed, {}, small) == {}


@pytest.mark.parametrize("small", [40, 1_000_000])
def test_jobs_do_not_grow_with_columns_or_ranks(spark, mixed, small):
    """Four scans at most: sizes, sketch, counts and gathering. Each shuffle is a job of its own, and gathering has two."""
    one, few = jobs_of(spark, f"one-{small}", lambda: order.select_ranks(mixed, {"x": [2000]}, small))
    all_, many = jobs_of(spark, f"all-{small}", lambda: order.select_ranks(mixed, {c: list(range(100, 3900, 400)) for c in ("x", "id", "money", "day")}, small))
    assert few <= 9 and many <= 9 and len(one) == 1 and len(all_) == 4


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.975, 1.0])
def test_quantiles_equal_percentile(mixed, share):
    """The seeking path against the built-in aggregate, for several columns at once."""
    columns = ["x", "few", "far out", "money", "gone"]
    got = order.quantiles(mixed, columns, [share], 50)
    row = mixed.selectExpr(*[f"percentile(`{c}`, {share}) as `{c}`" for c in columns]).first()
    for c in columns:
        value = mixed.selectExpr(f"max({got[c][0]})").first()[0]
        assert value == row[c] if value is None else abs(value - row[c]) <= 1e-9 * abs(row[c])


def test_queries_do_not_depend_on_the_path(spark, monkeypatch):
    """Profiles, boxes, folds, halves and reports are the same when every column is too long for one task."""
    from tabcast.plans.registry import QUERIES
    from tabcast.plans import catalog  # noqa: F401  (it registers)

    folder = "/root/testdata/sf0.001"
    names = ["profile_numeric", "describe", "boxplot", "residual_report", "scatter_report", "feature_frame"]
    def rounded(name):
        return sorted(tuple(float(f"{v:.9g}") if isinstance(v, float) else str(v) for v in r) for r in QUERIES[name](spark, folder).collect())
    before = {n: rounded(n) for n in names if n in QUERIES}
    for function in (order.quantiles, order.values_at, order.select_ranks):
        defaults = tuple(100 if d == order.SMALL_GROUP else d for d in function.__defaults__)
        monkeypatch.setattr(function, "__defaults__", defaults)
    assert len(before) >= 5 and {n: rounded(n) for n in before} == before
