"""Exact order statistics, running totals and lookups that hold at any size.

Nothing here sorts a whole table into one task. Positions asked for by rank
are found, all columns and ranks at once, by narrowing a bracket around each
value; running totals over sorted
distinct values use range partitions; lookups broadcast only what was counted.
"""

import itertools
import math
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabcast.functions import sql

# A group of at most this many values may be sorted by one task.
SMALL_GROUP = 1_000_000
# A lookup table of at most this many rows may be broadcast.
BROADCAST_ROWS = 200_000
# A key is hot when it holds more than one row in this many.
HOT_SHARE = 1_000
SKETCH_ACCURACY = 10_000


def at_most(df: DataFrame, bound: int) -> bool:
    """True when ``df`` has at most ``bound`` rows; stops counting just above it."""
    return df.limit(bound + 1).count() <= bound


def checkpoint_folder(spark) -> str:
    """The shared folder the session names; a local session gets one of its own if it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tabcast-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass
class _Seek:
    """One rank on its way: the open interval (low, high) that holds it, and how many values lie below and inside."""

    column: str
    position: int
    inside: int
    below: int = 0
    low: object = None
    high: object = None
    value: object = None
    found: bool = False

    def narrow(self, ends: list, counts: list[int]) -> None:
        """Take the part of the interval between two values that holds the rank.

        ``counts`` are the column's values under the lower end, up to it,
        under the upper end and up to it.
        """
        low, high = ends
        under, upto, before, through = counts
        top = self.below + self.inside
        if self.position < under:
            self.high, self.inside = low, under - self.below
        elif self.position < upto:
            self.value, self.below, self.found = low, under, True
        elif self.position < before:
            self.low, self.high, self.below, self.inside = low, high, upto, before - upto
        elif self.position < through:
            self.value, self.below, self.found = high, before, True
        else:
            self.low, self.below, self.inside = high, through, top - through


def select_ranks(df: DataFrame, wanted: dict[str, list[int]], small: int = SMALL_GROUP, sizes: dict[str, int] | None = None) -> dict[str, list[tuple]]:
    """(value, values below it) at 0-based ascending positions among the non-null values of each column.

    All ranks of all columns move together. One scan sketches a bracket
    around every rank, one counts exactly what lies below and in it, and one
    gathers the values of every bracket, each summed by value before it moves
    and sorted by a task of its own. Only brackets of more than ``small``
    values take another pair of scans, so the number of scans does not depend
    on columns or ranks. ``sizes`` spares the scan that counts non-null values.
    """
    if sizes is None:
        columns = list(wanted)
        sizes = dict(zip(columns, df.agg(*[F.count(F.col(sql.name(c))) for c in columns]).first())) if columns else {}
    seeks = []
    for c, positions in wanted.items():
        for p in positions:
            if not 0 <= p < sizes[c]:
                raise IndexError(f"position {p} outside {sizes[c]} values")
            seeks.append(_Seek(c, p, sizes[c]))
    while open_ := [s for s in seeks if not s.found and s.inside > small]:
        before = [s.inside for s in open_]
        _narrow_all(df, open_, _sketched(df, open_))
        stuck = [s for s, n in zip(open_, before) if not s.found and s.inside == n]
        if stuck:
            # The sketch works on doubles, too coarse for these whole numbers: halve their range instead.
            _narrow_all(df, stuck, _halved(df, stuck))
    rest = [s for s in seeks if not s.found]
    if rest:
        _gather(df, rest)
    done = iter(seeks)
    return {c: [(s.value, s.below) for s in itertools.islice(done, len(positions))] for c, positions in wanted.items()}


def values_at(df: DataFrame, column: str, positions: list[int], small: int = SMALL_GROUP, size: int | None = None) -> list:
    """Exact values at 0-based ascending positions of a numeric or date column."""
    found = select_ranks(df, {column: positions}, small, None if size is None else {column: size})
    return [value for value, _ in found[column]]


def typed_literal(value, dtype) -> Column:
    """Literal of exactly ``dtype``; dates go through text so no time zone applies."""
    return F.lit(value.isoformat() if hasattr(value, "isoformat") else value).cast(dtype)


def _within(df: DataFrame, seek: _Seek) -> Column:
    """Whether a row's value lies in the interval of a rank."""
    value, dtype = F.col(sql.name(seek.column)), df.schema[seek.column].dataType
    inside = value.isNotNull()
    if seek.low is not None:
        inside = inside & (value > typed_literal(seek.low, dtype))
    if seek.high is not None:
        inside = inside & (value < typed_literal(seek.high, dtype))
    return inside


def _sketched(df: DataFrame, seeks: list[_Seek]) -> list[list]:
    """Two values around each rank, from one sketch for each interval."""
    groups: dict[tuple, list[int]] = {}
    for i, s in enumerate(seeks):
        groups.setdefault((s.column, s.low, s.high), []).append(i)
    margin, wanted = 2.0 / SKETCH_ACCURACY, []
    for (column, _, _), members in groups.items():
        shares = []
        for i in members:
            middle = (seeks[i].position - seeks[i].below + 0.5) / seeks[i].inside
            shares += [max(middle - margin, 0.0), min(middle + margin, 1.0)]
        value = F.when(_within(df, seeks[members[0]]), F.col(sql.name(column)))
        wanted.append(F.percentile_approx(value, shares, SKETCH_ACCURACY))
    ends: list = [None] * len(seeks)
    for members, cuts in zip(groups.values(), df.agg(*wanted).first()):
        for place, i in enumerate(members):
            ends[i] = cuts[2 * place : 2 * place + 2]
    return ends


def _halved(df: DataFrame, seeks: list[_Seek]) -> list[list]:
    """The least value above the middle of each interval, twice, and so an interval of half the range."""
    columns = [F.when(_within(df, s), F.col(sql.name(s.column))) for s in seeks]
    limits = df.agg(*[f(c) for c in columns for f in (F.min, F.max)]).first()
    middles = [low + (high - low) // 2 for low, high in zip(limits[::2], limits[1::2])]
    return [[m, m] for m in middles]


def _narrow_all(df: DataFrame, seeks: list[_Seek], ends: list[list]) -> None:
    """Exact counts around all ends in one scan; whatever the sketch's error, they tell where each rank lies."""
    wanted = []
    for s, pair in zip(seeks, ends):
        value, dtype = F.col(sql.name(s.column)), df.schema[s.column].dataType
        for end in (typed_literal(e, dtype) for e in pair):
            wanted += [F.count_if(value < end), F.count_if(value <= end)]
    counts = df.agg(*wanted).first()
    for i, (s, pair) in enumerate(zip(seeks, ends)):
        s.narrow(list(pair), list(counts[4 * i : 4 * i + 4]))


def _gather(df: DataFrame, seeks: list[_Seek]) -> None:
    """Values of ranks whose intervals are small, all from one scan."""
    groups: dict[tuple, list[_Seek]] = {}
    for s in seeks:
        groups.setdefault((s.column, s.low, s.high), []).append(s)
    types = list(dict.fromkeys(df.schema[c].dataType.simpleString() for c, _, _ in groups))
    cells = []
    for number, ((column, _, _), members) in enumerate(groups.items()):
        own = df.schema[column].dataType.simpleString()
        parts = [(F.col(sql.name(column)) if t == own else F.lit(None)).cast(t).alias(f"v{i}") for i, t in enumerate(types)]
        cells.append(F.when(_within(df, members[0]), F.struct(F.lit(number).alias("k"), *parts)))
    values = [f"v{i}" for i in range(len(types))]
    rows = df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("k", *values).agg(F.count(F.lit(1)).alias("n"))
    # An interval has one task; it holds at most ``small`` values, or fewer where they repeat.
    so_far = Window.partitionBy("k").orderBy(*values).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = F.array(*[F.array(*[F.lit(s.position - s.below).cast("long") for s in members]) for members in groups.values()])
    ranked = rows.withColumn("upto", F.sum("n").over(so_far))
    met = F.filter(F.get(offsets, F.col("k")), lambda o: (o < F.col("upto")) & (o >= F.col("upto") - F.col("n")))
    hits = ranked.withColumn("offset", F.explode(met)).select("k", "offset", (F.col("upto") - F.col("n")).alias("under"), *values)
    members_of = list(groups.values())
    for hit in hits.collect():
        value = next((hit[v] for v in values if hit[v] is not None), None)
        for s in members_of[hit["k"]]:
            if s.position - s.below == hit["offset"] and not s.found:
                s.value, s.found, s.below = value, True, s.below + hit["under"]


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float], small: int = SMALL_GROUP) -> dict[str, list[str]]:
    """Exact interpolated quantiles as SQL to use inside one ``df.agg``.

    Below ``small`` rows these are the built-in aggregate; above it, its
    value map would not fit one task and literals found by
    ``select_ranks``, for all columns at once, take its place.
    """
    if at_most(df, small):
        # One aggregate per column, whatever the number of quantiles: equal calls are computed once.
        shares = ", ".join(repr(float(p)) for p in probabilities)
        return {c: [f"percentile({sql.name(c)}, array({shares}))[{i}]" for i in range(len(probabilities))] for c in columns}
    sizes = dict(zip(columns, df.agg(*[F.count(F.col(sql.name(c))) for c in columns]).first()))
    places = {c: [p * (n - 1) for p in probabilities] for c, n in sizes.items() if n}
    ends = {c: sorted({f(p) for p in at for f in (math.floor, math.ceil)}) for c, at in places.items()}
    found = select_ranks(df, ends, small, sizes)

    def between(column: str, place: float) -> float:
        at = {p: float(value) for p, (value, _) in zip(ends[column], found[column])}
        low, high = at[math.floor(place)], at[math.ceil(place)]
        return low + (place - math.floor(place)) * (high - low)

    return {c: [sql.number(between(c, p)) for p in places[c]] if c in places else ["cast(null as double)"] * len(probabilities) for c in columns}


def running_total(
    df: DataFrame, order_by: list[str], weight: Column, name: str, small: int = BROADCAST_ROWS, size: int | None = None,
) -> DataFrame:
    """Add ``name``: total weight of the rows that sort strictly before each row.

    ``order_by`` must be unique. Large inputs are split by sorted range, and
    the range of each row is fixed on shared storage before it is used twice.
    An already known ``size`` spares the counts.
    """
    rows = df.withColumn("_weight", weight.cast("bigint"))
    if at_most(df, small) if size is None else size <= small:
        before = Window.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn(name, F.sum("_weight").over(before) - F.col("_weight")).drop("_weight")
    ranges = max(2, math.ceil((rows.count() if size is None else size) / small))
    placed = materialise(rows.repartitionByRange(ranges, *order_by).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_range").agg(F.sum("_weight").alias("_total"))
        .select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    )
    if ranges <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    inside = Window.partitionBy("_range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.join(starts, "_range")
        .withColumn(name, F.col("_start") + F.sum("_weight").over(inside) - F.col("_weight"))
        .drop("_range", "_weight", "_start")
    )


def lookup(
    rows: DataFrame, table: DataFrame, key: str, how: str = "left", small: int = BROADCAST_ROWS, size: int | None = None,
) -> DataFrame:
    """Join a table with unique ``key`` to rows in which one key may be very common.

    A small table, by its counted or already known ``size``, is broadcast. Otherwise the hot keys, at most
    ``HOT_SHARE`` of them by definition, are broadcast and only the rest is
    shuffled.
    """
    if at_most(table, small) if size is None else size <= small:
        return rows.join(F.broadcast(table), key, how)
    per_key = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    total = rows.count()
    hot = materialise(per_key.where(F.col("count") * HOT_SHARE > total).select(key))
    hot_table = hot.join(table, key, how)
    common = rows.join(F.broadcast(hot_table), key, "inner")
    rare = rows.join(F.broadcast(hot), key, "left_anti")
    keyed = rare.where(F.col(key).isNotNull()).join(table, key, how)
    result = common.unionByName(keyed)
    if how == "left":
        return result.unionByName(rare.where(F.col(key).isNull()), allowMissingColumns=True)
    return result
