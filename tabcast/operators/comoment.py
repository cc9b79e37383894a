"""Pairwise sums of products of many columns in one scan, by matrix products per batch.

Built-in aggregates are best for a few columns. Their generated code grows
with the square of the columns and soon runs uncompiled, so wider sets go
through numpy here: each task returns one set of sums, however many rows it
saw, and Spark adds those up.
"""

from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.functions import sql

# Columns handled at once; wider sets are cut into pairs of blocks.
MAX_COLUMNS = 64
COLUMNS_PER_PASS = 25
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def centres(df: DataFrame, columns: list[str]) -> list[float]:
    """Column means, subtracted before summing so that no digits are lost."""
    found: list[float] = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        found += list(df.selectExpr(*[f"avg({sql.name(c)})" for c in columns[start:start + COLUMNS_PER_PASS]]).first())
    return [float(v) if v is not None else 0.0 for v in found]


def _blocks(size: int) -> list[list[int]]:
    """Column positions cut so that every pair meets in some block of at most ``MAX_COLUMNS``."""
    if size <= MAX_COLUMNS:
        return [list(range(size))]
    half = MAX_COLUMNS // 2
    parts = [list(range(at, min(at + half, size))) for at in range(0, size, half)]
    return [a + b for a, b in combinations(parts, 2)]


def pair_sums(df: DataFrame, columns: list[str], centre: list[float], by: str | None = None) -> DataFrame:
    """(key, i, j, n, sx, sy, sxx, syy, sxy) over rows complete in columns i <= j.

    ``by`` is a small whole number such as a fold; without it ``key`` is 0.
    """
    result, done = None, set()
    for block in _blocks(len(columns)):
        upper = [(a, b) for a, b in combinations_with_replacement(range(len(block)), 2) if (block[a], block[b]) not in done]
        done |= {(block[a], block[b]) for a, b in upper}
        part = _block_sums(df, columns, centre, by, block, upper)
        result = part if result is None else result.unionByName(part)
    return result


def _block_sums(df: DataFrame, columns: list[str], centre: list[float], by: str | None, block: list[int], upper: list) -> DataFrame:
    shift = np.array([centre[k] for k in block])
    first, second = (np.array(side) for side in zip(*upper))
    ids = np.array(block)

    def sums(batches):
        total: dict = {}
        for batch in batches:
            for key, part in batch.groupby("key"):
                x = part.iloc[:, 1:].to_numpy(dtype=float) - shift
                known = ~np.isnan(x)
                x, m = np.where(known, x, 0.0), known.astype(float)
                sx, sxx = x.T @ m, (x * x).T @ m
                got = np.stack([m.T @ m, sx, sx.T, sxx, sxx.T, x.T @ x])
                total[key] = total[key] + got if key in total else got
        for key, got in total.items():
            pairs = {"key": key, "i": ids[first], "j": ids[second]}
            yield pd.DataFrame(pairs | dict(zip(SUMS, got[:, first, second])))

    key = F.col(by).cast("int") if by else F.lit(0)
    rows = df.select(key.alias("key"), *[F.col(columns[k]).cast("double").alias(f"v{k}") for k in block])
    # Few, long tasks: what is shuffled is one set of sums per task.
    rows = rows.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    schema = "key int, i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    return rows.mapInPandas(sums, schema).groupBy("key", "i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
