"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two halves. Fingerprints at three or
fewer differing bits agree in one half up to one bit, so each fingerprint is
stored in a table under either half, and looks up the Hamming ball of radius
one around either half; complete distances decide. Only *distinct*
fingerprints are stored and looked up, so copies cost nothing.

A pair whose halves differ in one bit is looked up once, by the side that
has the bit set. Table buckets of more than ``BUCKET`` fingerprints get a
second level: a quarter of the other half (16 bits) joins the key, again with
radius one, so that no bucket holds more than 65,536 fingerprints. Inside a
bucket, links are found in tiles and only a star of each tile's components
leaves the task, never all pairs.

Defined cases: null and empty texts have fingerprint zero, which links like
any other. Rows repeating an id count once per fingerprint. Rows with a null
id have a component like any row, but never name one unless all rows of the
component have null ids (then it is null). Empty tables give no rows.
"""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabcast.llm import words
from tabcast.llm.components import connected_components
from tabcast.operators.order import materialise

SEED = 42
# Table entries of a bucket beyond which the key gets longer.
BUCKET = 2_048
_TILE = 2_048
_BLOCK = 1 << 14
_HALF = 0xFFFFFFFF


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """Unsigned SimHash of the shingles of a whole text, repeats included."""
    found = words.lower_words(raw or b"")
    if not found:
        return 0
    counts, n = np.zeros(64, np.int64), max(1, len(found) - shingle + 1)
    for at in range(0, n, _BLOCK):
        some = found[at : at + _BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(some[i:] for i in range(shingle)))) if len(some) >= shingle else [b" ".join(some)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def prints(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(raw, shingle) for raw in words.raw_texts(column)], np.uint64).view(np.int64))

    return prints(text)


def _tile_stars(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars that connect what links of at most ``most`` bits connect between two sets."""
    for i in range(0, len(a), _TILE):
        for j in range(0, len(b), _TILE):
            left, right = a[i : i + _TILE], b[j : j + _TILE]
            near = np.bitwise_count(left[:, None] ^ right[None, :]) <= most
            rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(rows):
                continue
            left, right, near = left[rows], right[cols], near[np.ix_(rows, cols)]
            far = len(right)
            labels = np.arange(far)
            while True:
                of_left = np.where(near, labels[None, :], far).min(axis=1)
                after = np.minimum(labels, np.where(near, of_left[:, None], far).min(axis=0))
                if (after == labels).all():
                    break
                labels = after
            yield left, right[of_left]
            yield right, right[labels]


def _bucket_stars(most: int):
    """mapInArrow function over (key, probe, fp) sorted by key and probe: the star edges of each bucket."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        now, table, inside = None, [], None
        for batch in batches:
            keys = batch.column("key").to_numpy()
            probes = batch.column("probe").to_numpy()
            prints = batch.column("fp").to_numpy().view(np.uint64)
            starts = words.starts_of_runs(keys)
            ends = np.append(starts[1:], len(keys))
            # A run can hold links if it has two rows, or is cut by the batch's ends.
            busy = (ends - starts > 1) | (starts == 0) | (ends == len(keys))
            out = []
            for s, e in zip(starts[busy].tolist(), ends[busy].tolist()):
                if keys[s] != now:
                    now, table, inside = keys[s], [], None
                cut = s + int(np.searchsorted(probes[s:e], 1))
                if cut > s:
                    fresh = prints[s:cut]
                    out += [x for old in table for x in _tile_stars(fresh, old, most)]
                    out += _tile_stars(fresh, fresh, most)
                    table.append(fresh)
                if cut < e and table:
                    inside = np.concatenate(table) if inside is None else inside
                    out += _tile_stars(prints[cut:e], inside, most)
            if out:
                u, v = (np.concatenate(side) for side in zip(*out))
                kept = u != v
                yield pa.RecordBatch.from_arrays([pa.array(u[kept].view(np.int64)), pa.array(v[kept].view(np.int64))], schema=schema)

    return stars


def _placed(table: DataFrame, probes: DataFrame) -> DataFrame:
    """Table and probe rows of a key in one partition, sorted.

    Joins before may leave both sides of the union dealt by the key, and the
    planner then drops an exchange by the key, although adaptive execution may
    merge the partitions of either side in its own way. Neither side is ever
    dealt by the hash of the key, so that this exchange stays.
    """
    met = probes.join(table.select("key").distinct(), "key", "left_semi")
    rows = table.withColumn("probe", F.lit(0)).unionByName(met.withColumn("probe", F.lit(1)))
    return rows.withColumn("spot", F.xxhash64("key")).repartition("spot").sortWithinPartitions("key", "probe")


def _stars(table: DataFrame, probes: DataFrame, most: int) -> DataFrame:
    placed = _placed(table, probes)
    return placed.select("key", "probe", "fp").mapInArrow(_bucket_stars(most), "u long, v long")


def _halves(fp: Column) -> list[Column]:
    return [fp.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(fp, 32)]


def _flipped(key: Column, width: int, only_clear: bool) -> Column:
    """The keys at one differing bit; only those with a bit fewer, if asked."""
    bits = F.array(*[F.lit(1 << i) for i in range(width)])
    if only_clear:
        bits = F.filter(bits, lambda bit: key.bitwiseAND(bit) != 0)
    return F.transform(bits, lambda bit: key.bitwiseXOR(bit))


def _plus(keys: Column, number: int) -> Column:
    return F.transform(keys, lambda key: key + F.lit(number))


def link_stars(prints: DataFrame, most: int = 3) -> DataFrame:
    """Edges (u, v) that connect exactly what links of at most ``most`` <= 3 bits connect.

    ``prints`` has one row per distinct fingerprint, column fp.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments with balls of radius one find at most 3 differing bits")
    fp = F.col("fp")
    # A key is (half, its number); level two adds (quarter, its number) of the other half.
    keys = F.array(*[F.struct((half + F.lit(n << 32)).alias("key")) for n, half in enumerate(_halves(fp))])
    table = prints.select("fp", F.inline(keys))
    near = F.flatten(F.array(*[_plus(_flipped(half, 32, True), n << 32) for n, half in enumerate(_halves(fp))]))
    probes = prints.select("fp", F.explode(near).alias("key"))
    full = materialise(table.groupBy("key").count().where(F.col("count") > BUCKET).select("key"))
    if full.isEmpty():
        return _stars(table, probes, most)

    first = _stars(table.join(full, "key", "left_anti"), probes.join(full, "key", "left_anti"), most)
    other = F.when(F.col("key") < F.lit(1 << 32), _halves(fp)[1]).otherwise(_halves(fp)[0])
    quarters = [other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16)]

    def longer(rows: DataFrame, keys_of) -> DataFrame:
        made = F.flatten(F.array(*[_plus(keys_of(q), n << 16) for n, q in enumerate(quarters)]))
        both = rows.select("fp", "key", F.explode(made).alias("quarter"))
        # 33 bits of the first key and 17 of the second fit one long.
        return both.select("fp", (F.shiftleft("key", 17) + F.col("quarter")).alias("key"))

    full_table, full_probes = table.join(full, "key", "left_semi"), probes.join(full, "key", "left_semi")
    second = _stars(
        longer(full_table, lambda q: F.array(q)),
        longer(full_table, lambda q: _flipped(q, 16, True))
        .unionByName(longer(full_probes, lambda q: F.concat(F.array(q), _flipped(q, 16, False)))),
        most,
    )
    return first.unionByName(second)


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3,
) -> DataFrame:
    """One row per document: its id, both parts of its row key, ``fp``, ``root`` and ``component_id``.

    ``component_id`` is the smallest id among the documents reachable over
    links of at most ``most`` bits; ``root`` the smallest fingerprint among them.
    """
    # The columns are named anew at once, so that no column of the input can clash.
    keyed = docs.select(
        docs[id_col].alias("id"), F.xxhash64(docs[id_col]).alias("_k1"),
        F.xxhash64(docs[text_col], docs[id_col]).alias("_k2"), fingerprint_column(docs[text_col], shingle).alias("fp"),
    )
    marked = materialise(keyed)
    # An aggregate for each distinct fingerprint: copies meet on the map side.
    prints = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(link_stars(prints.select("fp"), most)).withColumnRenamed("node", "fp")
    placed = prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("id", "_k1", "_k2", "fp", "root", "component_id").withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """The documents without near copies: the one with the smallest id of each component stays.

    Ids that are null rank last; among rows that repeat an id, the smallest
    hash of the text stays, and one of the rows that agree in both.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle, most)
    rank = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("_k1"), F.col("_k2"))
    chosen = groups.groupBy("root").agg(F.min(rank).alias("r")).select("r._k1", "r._k2")
    keyed = words.with_row_key(docs, id_col, text_col)
    kept = keyed.join(chosen.distinct(), ["_k1", "_k2"], "left_semi")
    # The rows lie by these two keys already.
    place = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k2"))
    return kept.withColumn("place", place).where("place = 1").select("row.*")
