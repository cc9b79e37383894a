"""Shapes of distributions: histogram, box, density, hexagonal counts, normal fit."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.functions import sql, values
from tabcast.operators import order
from tabcast.operators.profile import long_form

HEX_GRID = 22


def histogram(df: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """(bin, low, high, n, density) over [min, max] in equal bins, the last one closed."""
    x = F.col(column).cast("double")
    lo, hi, total = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if total and lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins if total else 1.0
    place = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    counts = df.where(x.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    slots = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    return slots.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        n.alias("n"),
        F.try_divide(n, F.lit(float(total)) * F.lit(width)).alias("density"),
    )


def boxplot(df: DataFrame, columns: list[str], standardise: bool = True) -> DataFrame:
    """Quartiles, whiskers that reach data within 1.5 IQR, and outliers per column."""
    parts = ("q25", "q50", "q75")
    quartiles = order.quantiles(df, columns, [0.25, 0.5, 0.75])
    wanted = []
    for i, c in enumerate(columns):
        wanted += [f"{q} as {part}_{i}" for q, part in zip(quartiles[c], parts)]
        std = sql.spread(f"var_samp({sql.name(c)})", f"avg({sql.name(c)})")
        wanted += [f"avg({sql.name(c)}) as mean_{i}", f"sqrt({std}) as std_{i}"]
    got = df.selectExpr(*wanted).first()
    rows = []
    for i, c in enumerate(columns):
        q1, q2, q3 = (got[f"{part}_{i}"] for part in parts)
        mean, std = (got[f"mean_{i}"], got[f"std_{i}"]) if standardise else (0.0, 1.0)
        reach = None if q1 is None else 1.5 * (q3 - q1)
        low, high = (None, None) if q1 is None else (q1 - reach, q3 + reach)
        x = sql.name(c)
        inside = f"{x} between {sql.number(low)} and {sql.number(high)}"
        values_of = {
            "q25": sql.number(q1), "q50": sql.number(q2), "q75": sql.number(q3),
            "whisker_low": f"min(case when {inside} then {x} end)", "whisker_high": f"max(case when {inside} then {x} end)",
        }
        scaled = {label: f"try_divide({v} - {sql.number(mean)}, {sql.number(std)})" for label, v in values_of.items()}
        rows.append(sql.struct(column=sql.text(c), **scaled, n_outliers=f"count_if(not ({inside}))"))
    return long_form(df, rows)


# The binned density differs from the exact one by at most this share of the kernel's peak.
KDE_TOLERANCE = 1e-6
# Kernel widths beyond which the kernel is below the last digit of a double.
_KERNEL_REACH = 9.0


def kde(df: DataFrame, column: str, points: int = 1000, exact: bool = False, tolerance: float = KDE_TOLERANCE) -> DataFrame:
    """(step, x, density): Gaussian density of the standardised column, Scott's width.

    Every value is split over the two nearest places of a fine grid, in one
    aggregate; then the grid, not the rows, meets the kernel. Between places
    ``d`` apart a kernel of width ``h`` is off its chord by at most
    ``d^2 / 8`` times its greatest curvature, ``1 / h^2`` of its peak, so
    ``d = h * sqrt(8 * tolerance)`` bounds the error. ``exact=True`` sums over
    the values themselves, each distinct value once.
    """
    x = F.col(sql.name(column)).cast("double")
    s = df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"),
    ).first()
    if s["lo"] == s["hi"]:
        raise ValueError(f"{column} needs two different values")
    rows = df.select(((x - F.lit(s["mean"])) / F.lit(s["std"])).alias("z")).where("z is not null")
    least, most = (s["lo"] - s["mean"]) / s["std"], (s["hi"] - s["mean"]) / s["std"]
    lo, hi = least - 0.5 * (most - least), most + 0.5 * (most - least)
    width = s["n"] ** -0.2
    if exact:
        masses = rows.groupBy("z").agg(F.count(F.lit(1)).alias("w"))
    else:
        masses = binned(rows, "z", least, width * math.sqrt(8 * tolerance))
    # Steps of the result that the kernel of a place reaches.
    apart = (hi - lo) / (points - 1)
    first = F.ceil((F.col("z") - F.lit(_KERNEL_REACH * width + lo)) / F.lit(apart))
    last = F.floor((F.col("z") + F.lit(_KERNEL_REACH * width - lo)) / F.lit(apart))
    near = F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(points - 1)).cast("int"))
    at = values.linspace(F.lit(lo), F.lit(hi), F.col("step"), points)
    gap = (at - F.col("z")) / F.lit(width)
    reached = masses.where(F.greatest(first, F.lit(0)) <= F.least(last, F.lit(points - 1)))
    sums = (
        reached.withColumn("step", F.explode(near))
        .groupBy("step").agg(F.sum(F.col("w") * F.exp(-0.5 * gap * gap)).alias("total"))
    )
    steps = df.sparkSession.range(points).select(F.col("id").cast("int").alias("step"))
    scale = s["n"] * width * math.sqrt(2 * math.pi)
    density = F.coalesce("total", F.lit(0.0)) / F.lit(scale)
    return steps.join(sums, "step", "left").select("step", at.alias("x"), density.alias("density"))


def binned(rows: DataFrame, column: str, start: float, apart: float) -> DataFrame:
    """(z, w): each value's unit mass split over the places around it of a grid, nearer ones taking more."""
    place = (F.col(column) - F.lit(start)) / F.lit(apart)
    cell = F.floor(place)
    # Sums per cell before the masses of neighbours meet: rows combine where they lie.
    cells = rows.select(cell.alias("cell"), (place - cell).alias("part")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("part").alias("above"))
    split = F.array(
        F.struct(F.col("cell"), (F.col("n") - F.col("above")).alias("w")),
        F.struct((F.col("cell") + 1).alias("cell"), F.col("above").alias("w")),
    )
    masses = cells.select(F.inline(split)).groupBy("cell").agg(F.sum("w").alias("w"))
    return masses.select((F.lit(start) + F.col("cell") * F.lit(apart)).alias("z"), "w")


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = HEX_GRID) -> DataFrame:
    """(x, y, n): occupied hexagons; each point goes to the nearer of two lattices."""
    full = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    x0, x1, y0, y1 = full.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if x0 is None:
        return full.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    x0, x1 = _widen(x0, x1)
    y0, y1 = _widen(y0, y1)
    pad = 1e-9 * (x1 - x0)
    x0, x1 = x0 - pad, x1 + pad
    wide, tall = (x1 - x0) / gridsize, (y1 - y0) / int(gridsize / math.sqrt(3))
    u, v = (F.col("x") - F.lit(x0)) / F.lit(wide), (F.col("y") - F.lit(y0)) / F.lit(tall)
    places = full.select(u.alias("u"), v.alias("v")).select(
        "u", "v", F.rint("u").alias("cu"), F.rint("v").alias("cv"),
        (F.floor("u") + 0.5).alias("su"), (F.floor("v") + 0.5).alias("sv"),
    )
    to_corner = F.pow(F.col("u") - F.col("cu"), F.lit(2)) + 3 * F.pow(F.col("v") - F.col("cv"), F.lit(2))
    to_centre = F.pow(F.col("u") - F.col("su"), F.lit(2)) + 3 * F.pow(F.col("v") - F.col("sv"), F.lit(2))
    corner = to_corner < to_centre
    counts = places.groupBy(
        F.when(corner, F.col("cu")).otherwise(F.col("su")).alias("hu"),
        F.when(corner, F.col("cv")).otherwise(F.col("sv")).alias("hv"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        (F.col("hu") * F.lit(wide) + F.lit(x0)).alias("x"), (F.col("hv") * F.lit(tall) + F.lit(y0)).alias("y"), "n",
    )


def _widen(low: float, high: float) -> tuple[float, float]:
    """A range of positive length."""
    if low < high:
        return low, high
    return (-0.1, 0.1) if low == 0 else (low - 0.1 * abs(low), high + 0.1 * abs(high))


def normal_fit(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, population deviation and range of a column."""
    x = F.col(column).cast("double")
    return df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))


def normal_curve(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Fitted normal density at evenly spaced points of the column's range."""
    fit = normal_fit(df, column).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = values.linspace(F.col("low"), F.col("high"), F.col("step"), points)
    z = F.try_divide(at - F.col("mean"), F.col("std"))
    density = F.try_divide(F.exp(-z * z / 2), F.col("std") * F.sqrt(F.lit(2.0) * F.lit(math.pi)))
    return fit.select("step", at.alias("x"), density.alias("density"))
