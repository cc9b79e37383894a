"""Triangular factors of tall tables, merged up a tree.

Each task reduces its rows to the triangle R of their QR factorisation, batch
by batch; triangles of up to ``FANOUT`` neighbouring tasks are stacked and
factorised again until one is left. Normal equations would square the
condition of the table; this does not. A triangle has the size of the column
list, whatever the number of rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.functions import sql
from tabcast.operators.order import materialise

FANOUT = 32
_SCHEMA = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("triangle", pa.list_(pa.float64()))])
_SQL = "node long, n long, triangle array<double>"


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, square whatever their number."""
    found = np.linalg.qr(rows, mode="r")
    return np.vstack([found, np.zeros((rows.shape[1] - len(found), rows.shape[1]))])


def _row(node: int, n: int, triangle: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"node": node, "n": n, "triangle": triangle.ravel().tolist()}], schema=_SCHEMA)


def _of_task(width: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, triangle = None, 0, np.zeros((width, width))
        for batch in filter(len, batches):
            node = batch.column("node")[0].as_py()
            columns = [batch.column(f"v{i}").to_numpy() for i in range(width)]
            triangle = _triangle(np.vstack([triangle, np.column_stack(columns)]))
            n += len(batch)
        if n:
            yield _row(node, n, triangle)

    return reduce


def _merged(width: int):
    def merge(group: pa.Table) -> pa.Table:
        stacked = np.array(group.column("triangle").to_pylist()).reshape(-1, width)
        row = _row(group.column("node")[0].as_py(), sum(group.column("n").to_pylist()), _triangle(stacked))
        return pa.Table.from_batches([row])

    return merge


def triangle(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """Number of complete rows, and R of a constant followed by the columns."""
    width = len(columns) + 1
    rows = df.select(*[F.col(sql.name(c)).cast("double").alias(f"v{i}") for i, c in enumerate(columns, 1)]).dropna()
    rows = rows.select(F.spark_partition_id().cast("long").alias("node"), F.lit(1.0).alias("v0"), *rows.columns)
    state = materialise(rows.mapInArrow(_of_task(width), _SQL))
    nodes = (state.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        nodes = -(-nodes // FANOUT)
        up = state.withColumn("node", F.floor(F.col("node") / FANOUT).cast("long"))
        state = up.groupBy("node").applyInArrow(_merged(width), _SQL)
    last = state.first()
    if last is None:
        return 0, np.zeros((width, width))
    return last["n"], np.array(last["triangle"]).reshape(width, width)
