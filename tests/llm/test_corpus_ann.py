"""Nearest neighbours: recall and exact scores against brute force."""

import numpy as np
import pytest

from tabcast.llm import ann


def brute(ids, vectors, top):
    out = {}
    for i, q in zip(ids, vectors):
        if i % 20:
            continue
        scores = ann.products(vectors, q)
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != i][:top]
        out[i] = [(int(ids[k]), float(scores[k])) for k in order]
    return out


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize(("count", "scaled"), [(900, False), (6000, True)])
def test_recall(spark, count, scaled, monkeypatch):
    monkeypatch.setattr(ann, "MIN_ROWS", 2000)
    rng = np.random.default_rng(count)
    vectors = rng.standard_normal((count, 32)).astype(np.float32)
    if scaled:
        vectors *= rng.uniform(0.5, 2, (count, 1)).astype(np.float32)
    ids = rng.permutation(count)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")
    got, want = found(ann.nearest(frame)), brute(ids, vectors.astype(float), 20)
    assert set(got) == set(want)
    true = {(int(i), float(s)) for q in want for i, s in ann_pairs(ids, vectors, q)}
    hits = 0
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and len(near) == 20
        assert all((i, s) in true for i, s in near) and q not in [i for i, _ in near]
        hits += len({i for i, _ in near} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def ann_pairs(ids, vectors, query):
    q = vectors[list(ids).index(query)].astype(float)
    return zip(ids, ann.products(vectors.astype(float), q))


def test_common_vector_and_odd_rows(spark):
    """Small tables are compared whole, so results are exact."""
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(60)] + [(100, [3.0, 0.0, 0.0]), (101, [0.0, 0.0, 0.0]), (102, None), (103, [1.0, None, 1.0]), (104, [1.0, float("nan"), 1.0]), (105, [float("inf"), 1.0, 1.0]), (None, same), (120, [1.0, 1.0]), (121, [2.0, 2.0]), (140, []), (160, [-1.0, -1.0, -1.0])]
    frame = spark.createDataFrame([(*r, "own", 3) for r in rows], "vec_id long, embedding array<double>, q string, shard int")
    got = found(ann.nearest(frame))
    clean = [(i, v) for i, v in rows if i is not None and v and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    want = brute(np.array([i for i, _ in clean]), np.array([v for _, v in clean]), 20)
    want[120] = [(121, 4.0)]
    assert got == want


def test_fewer_than_asked(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert found(ann.nearest(frame)) == {0: [(1, 2.0), (2, -1.0)]}


def test_no_vectors(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ascent_stops_at_longest_prefixes():
    rng = np.random.default_rng(1)
    forest = ann.Forest(rng.standard_normal((3000, 8)), trees=5, bits=16)
    queries = rng.standard_normal((40, 8))
    low, high = forest.runs(queries, 300)
    total = (high - low).sum(axis=0)
    assert (total >= 300).all()
    strings = forest._strings(np.hstack([queries, np.zeros((40, 1))]))
    for q in range(40):
        depth = next(d for d in range(16, -1, -1) if sum(int((row >> (16 - d) == s >> (16 - d)).sum()) for row, s in zip(forest.sorted, strings[:, q])) >= 300)
        assert total[q] == sum(int((row >> (16 - depth) == s >> (16 - depth)).sum()) for row, s in zip(forest.sorted, strings[:, q]))
