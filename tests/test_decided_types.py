"""Types decided by sketches against types from exact counts."""

import random

import pytest
from pyspark.sql import functions as F

from tabcast.operators import profile, typing


@pytest.fixture(scope="module")
def near_limits(spark):
    """Columns whose distinct counts lie at, just below and just above every limit of the rules."""
    n = 20_000
    columns = {}
    for k in (1, 2, 3, 14, 15, 16):
        columns[f"int_{k}"] = f"cast(id % {k} as int)"
    for k in (1, 2, 3):
        columns[f"float_{k}"] = f"cast(id % {k} as double) / 3"
    for k in (19, 20, 21, n // 20 - 1, n // 20, n // 20 + 1, n // 20 + 400):
        columns[f"text_{k}"] = f"concat('t', id % {k})"
    for k in (9 * n // 10 - 1, 9 * n // 10, 9 * n // 10 + 1, n):
        columns[f"id {k}"] = f"concat('x', id % {k})"
        columns[f"num {k}"] = f"id % {k}"
    columns |= {"gone": "cast(null as string)", "empty number": "cast(null as int)", "flag": "id % 2 = 0", "day": "date'2020-01-01'"}
    return spark.range(n).selectExpr(*[f"{e} as `{c}`" for c, e in columns.items()]).repartition(6).cache()


def test_same_types(near_limits):
    want = {r["column"]: (r["type"], r["n"], r["rule"]) for r in typing.detect_types(near_limits).collect()}
    got = {r["column"]: r for r in typing.decide_types(near_limits).collect()}
    assert {c: (r["type"], r["n"], r["rule"]) for c, r in got.items()} == want
    counted = {c for c, r in got.items() if r["counted"]}
    # Near a limit of thousands the sketch cannot tell; few values it counts exactly, and a key is far above.
    assert counted >= {"text_999", "text_1000", "text_1001", "id 18000", "num 17999"}
    assert not counted & {"int_2", "int_16", "float_3", "text_1400", "id 20000", "num 20000", "gone", "flag", "day"}


def test_names_and_empty_tables(spark, near_limits):
    names = {"num 20000": "amount", "text_1400": "Code"}
    want = {r["column"]: r["rule"] for r in typing.detect_types(near_limits, names).collect()}
    assert {r["column"]: r["rule"] for r in typing.decide_types(near_limits, names).collect()} == want
    none = near_limits.limit(0)
    assert typing.type_map(typing.decide_types(none)) == typing.type_map(typing.detect_types(none))


def test_sketch_error(spark):
    """Estimates of many sets lie well within the interval."""
    rng = random.Random(1)
    for n in (1, 50, 900, 5_000, 60_000):
        df = spark.range(3 * n).selectExpr(f"id % {n} + {rng.randint(0, 10**9)} as v").union(spark.createDataFrame([(None,)], "v long"))
        estimate = df.selectExpr(f"{profile.sketched_distinct('v')} as e").first()["e"]
        low, high = profile.sketch_interval(estimate)
        assert low <= n <= high and abs(estimate - n) <= 0.03 * n


def test_exact_counts_do_not_copy_rows(near_limits):
    """One plan a column, none of which expands rows."""
    counts = profile.distinct_counts(near_limits, ["text_20", "num 20000", "gone"])
    assert {r["column"]: r["n_unique"] for r in counts.collect()} == {"text_20": 20, "num 20000": 20_000, "gone": 0}
    assert "Expand" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert profile.count_distinct(near_limits.select(F.lit(1).alias("a")), {}).count() == 0
