"""Line dedup by a suffix array over line-ID sequences, built by prefix doubling.

A document is the sequence of its non-blank lines. A suffix starts at any
line; its rank at a depth is the number of suffixes that sort before its
first so many lines. The next depth sorts by the pair (own rank, rank that
many lines on), so ranks come from sums over distinct pairs, which partial
aggregates count. Suffixes that share their rank with no other leave, and
doubling goes on until no rank is shared. Each depth is written as a Parquet
table: a checkpoint hands on the planner's estimate of its size, a join
multiplies estimates, and so their digits would grow fourfold a depth on the
driver.

Suffixes of equal rank are the intervals of the suffix array whose common
prefix has at least that depth. The first suffix of an interval (smallest
document id, then line) stays; all others are later copies of its prefix.
Each place keeps the longest copy found there; neighbouring copies whose
first places neighbour too make one maximal repeated run.

A repeated run counts if it has ``min_lines`` lines or ``min_words`` words.
Below ``min_lines`` the depth grows by one line instead of doubling, so that
short runs are judged by their own words.

Lines are compared without surrounding white space, by 64-bit hash; a run of
two or more lines is compared by as many hashes.

Defined cases: null texts stay null, texts without a repeated run stay as
they are, a text of which no line is left becomes empty. Blank lines take no
part; those inside a deleted run go with it. Null ids sort last. Rows that
repeat id and text count as one document. Overlapping copies in one document
(a b a b a b) keep the first place's lines.
"""

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabcast.llm import words
from tabcast.operators.order import HOT_SHARE, materialise, running_total

MIN_LINES = 2
MIN_WORDS = 10
# Distinct ranks that one task sorts.
_SORTED = 100_000
# Suffixes of one rank that may meet in one task. Each broadcast holds pages of the driver's memory, so only hotter ranks are broadcast.
_TOGETHER = 50_000
_KEY = ["_k1", "_k2"]
_PLACE = ["id", *_KEY, "pos", "line"]
_SPACE = " \t\r\f\v"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, pos, line, h, words) of every non-blank line; ``line`` counts blank ones too."""
    cut = F.transform(F.split(F.col("text"), "\n"), lambda text, i: F.struct(i.alias("line"), F.trim(text, F.lit(_SPACE)).alias("text")))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[id_col]).alias("_k1"), F.xxhash64(docs[text_col], docs[id_col]).alias("_k2"))
    found = rows.select("id", *_KEY, F.posexplode(F.filter(cut, lambda x: x["text"] != "")).alias("pos", "at"))
    n_words = F.size(F.split("at.text", f"[{_SPACE}]+"))
    return found.select("id", *_KEY, "pos", F.col("at.line").alias("line"), F.xxhash64("at.text").alias("key"), n_words.alias("words"))


def _ranked(rows: DataFrame) -> DataFrame | None:
    """The rows whose ``key`` is not unique, with ``rank`` and the ``first`` place of the key instead; None if there are none."""
    place = F.struct(F.col("id").isNull().alias("n"), *_PLACE)
    shared = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min(place).alias("first")).where("count > 1"))
    size, total, most = shared.agg(F.count(F.lit(1)), F.sum("count"), F.max("count")).first()
    if not size:
        return None
    ranks = running_total(shared, ["key"], F.col("count"), "rank", _SORTED, size)
    hot = max(_TOGETHER, total // HOT_SHARE)
    if most <= hot:
        return rows.join(ranks.drop("count").hint("merge"), "key").drop("key")
    # At most HOT_SHARE keys are hot; their rows stay where they are.
    ranks = materialise(ranks)
    marked = rows.join(F.broadcast(ranks.where(F.col("count") > hot).drop("count")), "key", "left")
    others = ranks.where(F.col("count") <= hot).drop("count").hint("merge")
    rare = marked.where("rank is null").drop("rank", "first").join(others, "key")
    return marked.where("rank is not null").unionByName(rare).drop("key")


def intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES):
    """Depth after depth, the suffixes that share their rank there: (depth, place, last, words, rank, first).

    ``last`` is the line at which the prefix of that depth ends.
    """
    lines = words.stored(_lines(docs, id_col, text_col))
    # Rows that repeat id and text are one document.
    ranked, depth = _ranked(lines), 1
    if ranked is None:
        return
    single = suffixes = words.stored(ranked.withColumn("last", F.col("line")).dropDuplicates([*_KEY, "pos"]))
    while True:
        yield depth, suffixes
        # Short runs grow by a line, longer ones double.
        by, more = (single, 1) if depth < min_lines else (suffixes, depth)
        on = by.select(*_KEY, (F.col("pos") - depth).alias("pos"), F.col("rank").alias("next"), F.col("last").alias("end"), F.col("words").alias("more"))
        pairs = suffixes.join(on.hint("merge"), [*_KEY, "pos"]).select(
            *_PLACE, F.col("end").alias("last"), (F.col("words") + F.col("more")).alias("words"), F.struct("rank", "next").alias("key"),
        )
        ranked = _ranked(words.stored(pairs))
        if ranked is None:
            return
        suffixes = words.stored(ranked)
        depth += more


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS,
) -> DataFrame:
    """The longest later copy found at each place: (id, k1, k2, pos, line, last) and the place of its first copy.

    Columns ``first_*`` name the first place; ``line`` and ``last`` are the
    line numbers of the copy's ends, counted with blank lines.
    """
    if min_lines < 1:
        raise ValueError("a run has at least one line")
    later = (F.col("first._k1") != F.col("_k1")) | (F.col("first._k2") != F.col("_k2")) | (F.col("first.pos") != F.col("pos"))
    found = [
        suffixes.where(later if depth >= min_lines else later & (F.col("words") >= min_words))
        .select(*_KEY, "pos", F.struct("last", "id", "line", "first").alias("copy"))
        for depth, suffixes in intervals(docs, id_col, text_col, min_lines)
    ]
    if not found:
        found = [
            docs.limit(0).select(
                *[F.lit(0).cast("long").alias(k) for k in _KEY], F.lit(0).alias("pos"),
                F.struct(
                    F.lit(0).alias("last"), docs[id_col].alias("id"), F.lit(0).alias("line"),
                    F.struct(docs[id_col].alias("id"), *[F.lit(0).cast("long").alias(k) for k in _KEY], F.lit(0).alias("pos"), F.lit(0).alias("line")).alias("first"),
                ).alias("copy"),
            )
        ]
    longest = reduce(DataFrame.unionAll, found).groupBy(*_KEY, "pos").agg(F.max_by("copy", "copy.last").alias("copy"))
    return longest.select(
        "copy.id", *_KEY, "pos", "copy.line", "copy.last", F.col("copy.first.id").alias("first_id"), F.col("copy.first._k1").alias("first_k1"),
        F.col("copy.first._k2").alias("first_k2"), F.col("copy.first.pos").alias("first_pos"), F.col("copy.first.line").alias("first_line"),
    )


def maximal_runs(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Copies joined to maximal runs: id, start_line, end_line, first_id, first_line, per copied run."""
    same = ["_k1", "_k2", "first_k1", "first_k2", "shift"]
    rows = found.withColumn("shift", F.col("pos") - F.col("first_pos"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*same).orderBy("pos"))
    joined = rows.withColumn("island", island).groupBy(*same, "island").agg(
        F.first("id").alias(id_col), F.min("line").alias("start_line"), F.max("last").alias("end_line"),
        F.first("first_id").alias("first_id"), F.min("first_line").alias("first_line"),
    )
    # The tail of a run may have an earlier first place of its own; it lies inside the run.
    before = Window.partitionBy(*_KEY).orderBy("start_line", F.desc("end_line"), "shift", *same[2:4]).rowsBetween(Window.unboundedPreceding, -1)
    outer = joined.withColumn("reached", F.max("end_line").over(before)).where("reached is null or reached < end_line")
    return outer.select(id_col, "start_line", "end_line", "first_id", "first_line")


def without_cuts(whole: str, cuts: list[dict]) -> str:
    """The text without the lines of its cuts (first and last line number)."""
    lines, kept, at = whole.split("\n"), [], 0
    for first, last in sorted((c["line"], c["last"]) for c in cuts):
        if first > at:
            kept += lines[at:first]
        at = max(at, last + 1)
    return "\n".join(kept + lines[at:])


def _without(text: Column, cuts: Column) -> Column:
    """Null where the text or its cuts are null."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        pairs = zip(words.raw_texts(texts), lists.to_pylist())
        return pa.array([None if raw is None or some is None else without_cuts(raw.decode(), some) for raw, some in pairs], pa.string())

    return cut(text, cuts)


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, name: str | None = None,
) -> DataFrame:
    """All documents, the text without later copies of repeated runs; in column ``name``, if given, beside the text."""
    found = copies(docs, id_col, text_col, min_lines, min_words).select(*_KEY, F.struct("line", "last").alias("cut"))
    cuts = found.groupBy(*_KEY).agg(F.collect_list("cut").alias("_cuts"))
    keyed = words.with_row_key(docs, id_col, text_col).join(cuts, _KEY, "left")
    text = F.col("row")[text_col]
    # Only texts that lose a line go to Python.
    less = F.coalesce(_without(F.when(F.col("_cuts").isNotNull(), text), F.col("_cuts")), text)
    if name:
        return keyed.select("row.*", less.alias(name))
    return keyed.select(F.col("row").withField(text_col, less).alias("row")).select("row.*")
