"""Clustering over approximations against plain k-means on whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from tabcast.llm import vector_clusters


def slow_clusters(rows, count, dims, rounds):
    """(id, cluster, distance) of every vector, and the final centroids, by comparing everything."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(64 * x) for x in v]
            if all(abs(x) <= 1 << 27 for x in whole):
                kept.append((i, whole))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(x) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], centroids


def check(frame, rows, count=16, dims=64, rounds=3, **settings):
    want, centroids = slow_clusters(rows, count, dims, rounds)
    got = vector_clusters.cluster(frame, count=count, dims=dims, rounds=rounds, **settings).collect()
    key = str
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(want, key=key)
    inertia = {}
    for _, c, d in want:
        inertia[c] = inertia.get(c, 0) + d
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def made(spark, vectors, kind="float"):
    rows = [(i, v if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    return rows, spark.createDataFrame([(*r, "own", 5) for r in rows], f"vec_id long, embedding array<{kind}>, cluster string, row int").repartition(5)


def clustered(count, dims, spread, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, dims))
    return (centres[rng.integers(0, 7, count)] + spread * rng.standard_normal((count, dims))).astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize(("bits", "share"), [(1, 1.0), (3, 0.25), (5, 0.0), (5, 1.0), (8, 1.0)])
def test_against_all_comparisons(spark, bits, share, monkeypatch):
    """Whatever the bits, and whether later rounds fetch or read all, results are those of plain k-means."""
    monkeypatch.setattr(vector_clusters, "DIRECT_SHARE", share)
    rows, frame = made(spark, clustered(500, 12, 0.4))
    check(frame, rows, dims=12, bits=bits)


def test_fetches_fall_with_bits(spark, monkeypatch):
    monkeypatch.setattr(vector_clusters, "DIRECT_SHARE", 1.0)
    _, frame = made(spark, clustered(800, 16, 0.1))
    counts = []
    for bits in (1, 3, 6):
        fetches = []
        vector_clusters.cluster(frame, dims=16, bits=bits, fetches=fetches).count()
        counts.append(fetches)
    assert len(counts[0]) == 3 and sum(counts[0]) > sum(counts[1]) > sum(counts[2])
    assert max(counts[2][1:]) < 800


@pytest.mark.parametrize("small", [0, 200_000])
def test_fetch_by_shuffle_and_by_broadcast(spark, small, monkeypatch):
    monkeypatch.setattr(vector_clusters, "DIRECT_SHARE", 1.0)
    monkeypatch.setattr(vector_clusters, "BROADCAST_ROWS", small)
    rows, frame = made(spark, clustered(300, 8, 0.5))
    check(frame, rows, dims=8, bits=2)


def test_odd_rows(spark):
    """Nulls, lengths, infinities, large numbers, ties, copies and repeated ids."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, (60, 4)).tolist()  # few different vectors: many ties
    vectors += [[0.5, -0.5, 0.25, 0.1]] * 50 + [None, [], [1.0] * 3, [1.0] * 5, [1.0, None, 0.0, 0.0], [float("nan"), 0.0, 0.0, 0.0]]
    vectors += [[0.0, float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0, 0.0], [2.0**21, -(2.0**21), 0.0, 1.0], [2.0**21 + 1, 0.0, 0.0, 1.0]]
    rows, frame = made(spark, vectors, "double")
    check(frame, rows, dims=4, bits=2)
    again = [(7, [0.25, 1.0, 2.0, 0.0]), (7, [0.25, 1.0, 2.0, 0.0]), (7, [3.0, 1.0, 2.0, 0.0]), (None, [3.0, 1.0, -2.0, 0.0]), (None, [0.0] * 4)]
    check(spark.createDataFrame(again, "vec_id long, embedding array<double>"), again, count=3, dims=4)


def test_few_and_none(spark):
    rows, frame = made(spark, clustered(5, 64, 0.3))
    check(frame, rows)
    empty = vector_clusters.cluster(frame.limit(0))
    assert empty.count() == 0 and empty.columns == vector_clusters.cluster(frame).columns


def test_bounds_hold():
    """Intervals hold every distance; one border is itself a value."""
    rng = np.random.default_rng(0)
    vectors = rng.integers(-40, 40, (300, 6))
    cells = vector_clusters.Cells([[-20, 0, 0, 21]] * 6, vectors.min(axis=0).tolist(), vectors.max(axis=0).tolist(), 3)
    bounds = vector_clusters.Bounds(cells, rng.integers(-60, 60, (5, 6)))
    import pyarrow as pa

    at = cells.decode(pa.array(cells.encode(vectors), pa.binary())) + np.arange(6) * cells.size
    true = ((vectors[:, None] - bounds.centroids[None]) ** 2).sum(axis=2)
    least, most = (np.stack([t[at].sum(axis=1) for t in table], axis=1) for table in (bounds.least, bounds.most))
    assert (least <= true).all() and (true <= most).all() and (least < most).any()
