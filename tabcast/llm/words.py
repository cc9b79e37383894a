"""Words, hashes, row keys and grouped output shared by the corpus operators.

Texts reach the functions here as UTF-8 bytes: ``bytes.translate`` and
``bytes.split`` cut a whole text in C, whatever its length, and never touch
the bytes of a non-ASCII character.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.operators.order import checkpoint_folder

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Digits, letters and every byte of a non-ASCII character stay; all else becomes a space.
FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 16
# Texts of a column that are Python objects at one time.
_AT_ONCE = 128


def raw_texts(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, few of them at a time; None for null."""
    for at in range(0, len(column), _AT_ONCE):
        yield from column.slice(at, _AT_ONCE).cast(pa.large_binary()).to_pylist()


def space_words(raw: bytes) -> list[bytes]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return raw.split()


def lower_words(raw: bytes) -> list[bytes]:
    """``space_words`` with A-Z in lower case."""
    return raw.translate(LOWER).split()


def folded_words(raw: bytes) -> list[bytes]:
    """Lower-cased runs of digits, letters a-z and non-ASCII characters."""
    return raw.translate(FOLDED).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP = _powers(_BASE, _STEP + 1024)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _STEP + 1024)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` (at most 1024) neighbouring word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _STEP):
        some = hashes[at : at + _STEP + width - 1]
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * _UP[: len(some)], out=sums[1:])
        m = len(some) - width + 1
        out[at : at + m] = (sums[width:] - sums[:-width]) * _DOWN[:m]
    return mixed(out)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word hashes: what ``window_hashes`` gives for such a window."""
    return mixed((rows * _UP[: rows.shape[1]]).sum(axis=1, dtype=np.uint64))


def starts_of_runs(keys: np.ndarray) -> np.ndarray:
    """Where a new value starts in a sorted or grouped array."""
    if not len(keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, _k1, _k2): the whole row as a struct, and two 64-bit columns that tell rows apart by id and text.

    Both are never null and hold whatever the id's type; rows that repeat id
    and text share them, so such rows are treated alike. No column of the
    input can clash with them.
    """
    ident, text = docs[id_col], docs[text_col]
    return docs.select(F.struct("*").alias("row"), F.xxhash64(ident).alias("_k1"), F.xxhash64(text, ident).alias("_k2"))


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage is cut, and columns can be read alone."""
    path = f"{checkpoint_folder(rows.sparkSession)}/tabcast-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors, once a session, for clusters where it is not installed."""
    import os
    import shutil
    import tempfile

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tabcast-"), "tabcast"), "zip", top, "tabcast")
    context.addPyFile(made)
    _shipped.add(context.applicationId)
