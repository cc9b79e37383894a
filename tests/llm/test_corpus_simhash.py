"""SimHash fingerprints and groups against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabcast.llm import components, simhash


def slow_fingerprint(text, k):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    grams = [" ".join(found[i : i + k]) for i in range(max(1, len(found) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, most=3):
    """Smallest member of each print's component."""
    prints = sorted(set(prints))
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= most:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {p: root(p) for p in prints}


def test_fingerprints(rows):
    for r in rows:
        raw = None if r[1] is None else r[1].encode()
        if len(r[1] or "") < 20_000:
            assert simhash.fingerprint(raw) == slow_fingerprint(r[1], 3)


def test_long_text_in_blocks(rows, monkeypatch):
    text = max((r[1] for r in rows if r[1]), key=len).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 101)
    assert simhash.fingerprint(text) == whole


def check_groups(docs, rows, **settings):
    got = simhash.simhash_groups(docs, **settings).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in rows:
        prints.setdefault((r[0], r[1]), slow_fingerprint(r[1], 3) if len(r[1] or "") < 20_000 else simhash.fingerprint(r[1].encode()))
    roots = slow_components(prints.values())
    least = {}
    for (ident, _), p in prints.items():
        if ident is not None:
            least[roots[p]] = min(ident, least.get(roots[p], ident))
    want = sorted((ident, p, least.get(roots[p])) for (ident, text), p in prints.items() for r in rows if (r[0], r[1]) == (ident, text) and ident is not None)
    assert sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got if r["doc_id"] is not None) == want
    return roots, prints


def test_groups(docs, rows):
    check_groups(docs, rows)


def test_keep_one(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    roots, prints = check_groups(docs, rows)
    assert sorted(roots[prints[r["doc_id"], r["text"]]] for r in got) == sorted(set(roots.values()))
    for r in got:
        same = [i for (i, t), p in prints.items() if roots[p] == roots[prints[r["doc_id"], r["text"]]] and i is not None]
        assert r["doc_id"] == min(same, default=None)


def check_links(spark, prints):
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.link_stars(table)).collect()}
    mask = (1 << 64) - 1
    found, want = {}, {}
    for p in signed:
        found.setdefault(roots.get(p, p), set()).add(p & mask)
    for p, root in slow_components(prints).items():
        want.setdefault(root, set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


@pytest.fixture(params=[(3, True), (8, True), (211, True), (8, False)], ids=str)
def shuffled(spark, request):
    """Shuffle partitions and adaptive execution; both decide where equal keys meet."""
    settings = dict(zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"), map(str, request.param)))
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("bucket", [2048, 4])
def test_links(spark, monkeypatch, bucket, shuffled):
    """Dense balls of fingerprints; a small bucket size sends them through the second level."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "_TILE", 7)
    rng = random.Random(bucket)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        bits = rng.sample(range(64), 12)
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in rng.sample(bits, rng.randint(0, 5))))
    prints |= {0, 1, (1 << 64) - 1, 1 << 63, 0b1111, 0b11110000}
    check_links(spark, prints)


def test_links_beside_a_full_bucket(spark):
    """More fingerprints share one half than a bucket holds, as shipped; pairs of the other buckets keep their links."""
    rng = random.Random(1)
    shared = rng.getrandbits(32)
    prints = {shared << 32 | rng.getrandbits(32) for _ in range(simhash.BUCKET + 550)}
    for _ in range(700):
        centre = rng.getrandbits(64)
        prints |= {centre, centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    check_links(spark, prints)


def test_exchange_stays(spark):
    """Sides that are dealt by the key already are dealt again, together."""
    full = spark.createDataFrame([(1,)], "key long").hint("shuffle_hash")
    rows = spark.range(100).select(F.col("id").alias("fp"), (F.col("id") % 7).alias("key")).join(full, "key", "left_anti")
    plan = simhash._placed(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan[: plan.index("Union")]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201), (201, 200)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    roots = {r["node"]: r["root"] for r in got.collect()}
    assert roots == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)} | {201: 200}


def test_hash_is_sparks(spark):
    row = spark.createDataFrame([("one two thréé",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest("one two thréé".encode(), 42)


def test_too_many_bits(spark):
    with pytest.raises(ValueError):
        simhash.link_stars(spark.createDataFrame([(1,)], "fp long"), 4)


def test_empty(no_docs):
    assert simhash.simhash_groups(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
