"""Features by semantic type: calendar parts, label codes, filled numbers, scaling.

Everything learnt from data (label codes, medians, means, deviations) is kept
at fit and reused at transform. Label codes live in a DataFrame and reach the
rows by a lookup, so a column may have any number of labels.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabcast.functions import sql, values
from tabcast.operators import order
from tabcast.sources.tables import feature_columns

LABELLED = ("binary", "categorical", "ordinal")
UNKNOWN_CODE = -1
COLUMNS_PER_PASS = 20


def label_map(df: DataFrame, column: str) -> DataFrame:
    """(label, n, code): labels in text order, a missing value under its own label."""
    counts = df.groupBy(values.label_text(F.col(column)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return order.running_total(counts, ["label"], F.lit(1), "code")


def appearance_map(df: DataFrame, column: str, key: str) -> DataFrame:
    """(label, n, code): labels in the order in which ``key`` first shows them."""
    firsts = df.groupBy(values.label_text(F.col(column)).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"),
    )
    coded = order.running_total(firsts, ["first_key", "label"], F.lit(1), "code")
    return coded.select("label", "n", "code")


def apply_codes(df: DataFrame, column: str, codes: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """Add ``name``, the code of each value; a label not in ``codes`` gives -1."""
    table = codes.select(F.col("label").alias("_label"), F.col("code").cast("int").alias("_code"))
    rows = order.lookup(df.withColumn("_label", values.label_text(F.col(column))), table, "_label", size=size)
    return rows.withColumn(name, F.coalesce("_code", F.lit(UNKNOWN_CODE))).drop("_label", "_code")


def given_order(spark, labels: list) -> DataFrame:
    """Codes in an order stated by the caller."""
    rows = [(str(label), code) for code, label in enumerate(labels)]
    return spark.createDataFrame(rows, "label string, code bigint")


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers; what is no number becomes null."""
    return df.select([values.to_number(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_missing(df: DataFrame, numbers: list[str] = (), texts: list[str] = (), medians: dict | None = None) -> DataFrame:
    """Numbers filled with their exact median (0 if all are missing), texts with the missing label."""
    medians = column_medians(df, list(numbers)) if medians is None else medians
    filled = {c: F.coalesce(F.col(c), F.lit(medians[c]), F.lit(0.0)) for c in numbers}
    filled |= {c: values.label_text(F.col(c)) for c in texts}
    return df.select([filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    found = order.quantiles(df, columns, [0.5])
    return df.selectExpr(*[f"cast({found[c][0]} as double) as {sql.name(c)}" for c in columns]).first().asDict()


def scale_stats(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column."""
    stats: dict = {}
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        batch = columns[start:start + COLUMNS_PER_PASS]
        wanted = [f"avg({sql.name(c)}) as m{i}" for i, c in enumerate(batch)]
        wanted += [
            f"sqrt({sql.spread(f'var_pop({sql.name(c)})', f'avg({sql.name(c)})')}) as s{i}" for i, c in enumerate(batch)
        ]
        row = df.selectExpr(*wanted).first()
        stats |= {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(batch)}
    return stats


def scaled(column: Column, mean: float, std: float) -> Column:
    """Distance from the mean in deviations; a constant column is only centred."""
    return (column - F.lit(mean)) / F.lit(std if std > 0 else 1.0)


def scale_features(df: DataFrame, columns: list[str], keep: tuple = ()) -> DataFrame:
    stats = scale_stats(df, columns)
    return df.select(*keep, *[scaled(F.col(c), *stats[c]).alias(c) for c in columns])


class Preprocessor:
    """Turns raw columns into scaled numeric features named ``z_<feature>``.

    ``key`` orders rows for the first-appearance codes of binary columns and
    is never a feature itself. ``label_order`` gives the labels of an ordinal
    column in their real order; text order is the default.
    """

    def __init__(self, types: dict[str, str], key: str | None = None, label_order: dict[str, list] | None = None):
        self.types = types
        self.key = key
        self.label_order = label_order or {}
        self.inputs: list[str] = []
        self.codes: dict[str, tuple[DataFrame, int]] = {}
        self.medians: dict[str, float | None] = {}
        self.stats: dict[str, tuple[float, float]] = {}

    @property
    def outputs(self) -> list[str]:
        return [f"z_{name}" for name in self.stats]

    def fit(self, df: DataFrame, target: str) -> "Preprocessor":
        self.inputs = [c for c in feature_columns(df, self.types, target) if c != self.key]
        labelled = [c for c in self.inputs if self.types.get(c) in LABELLED]
        self.codes = self._learn_codes(df, labelled)
        numbers = [c for c in self.inputs if self.types.get(c, "continuous") in ("continuous", "integer")]
        as_numbers = df.select([values.to_number(F.col(c)).alias(c) for c in numbers])
        self.medians = column_medians(as_numbers, numbers)
        encoded = self.encode(df)
        self.stats = scale_stats(encoded, encoded.columns)
        return self

    def _learn_codes(self, df: DataFrame, columns: list[str]) -> dict[str, tuple[DataFrame, int]]:
        """Labels of all columns in one pass, then their codes column by column."""
        if not columns:
            return {}
        if self.key is None and any(self.types[c] == "binary" for c in columns):
            raise ValueError("binary columns are coded by first appearance: give a key that orders rows")
        key = F.col(self.key) if self.key else F.lit(0)
        cells = df.select(key.alias("_key"), *[values.label_text(F.col(c)).alias(c) for c in columns])
        labels = order.materialise(
            cells.unpivot(["_key"], columns, "column", "label").groupBy("column", "label").agg(F.min("_key").alias("first_key"))
        )
        sizes = {r["column"]: r["count"] for r in labels.groupBy("column").count().collect()}
        codes = {}
        for c in columns:
            if c in self.label_order:
                codes[c] = (given_order(df.sparkSession, self.label_order[c]), len(self.label_order[c]))
                continue
            by = ["first_key", "label"] if self.types[c] == "binary" else ["label"]
            mine = labels.where(F.col("column") == c)
            if sizes[c] <= order.BROADCAST_ROWS:
                coded = mine.withColumn("code", F.row_number().over(Window.orderBy(*by)) - 1)
            else:
                coded = order.running_total(mine, by, F.lit(1), "code")
            codes[c] = (coded.select("label", "code"), sizes[c])
        return codes

    def _encode(self, df: DataFrame, keep: tuple) -> DataFrame:
        """``keep`` as it is, then unscaled features under their output names."""
        rows = df.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], *self.inputs)
        for c, (codes, size) in self.codes.items():
            rows = apply_codes(rows, c, codes, f"z_{c}", size)
        columns = []
        for c in self.inputs:
            if c in self.codes:
                columns.append(F.col(f"z_{c}").cast("double").alias(f"z_{c}"))
            elif self.types.get(c) == "date":
                parts = values.date_parts(values.as_timestamp(F.col(c), df.schema[c].dataType))
                columns += [part.cast("double").alias(f"z_{c}_{name}") for name, part in parts.items()]
            else:
                columns.append(F.coalesce(values.to_number(F.col(c)), F.lit(self.medians[c]), F.lit(0.0)).alias(f"z_{c}"))
        return rows.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], *columns)

    def encode(self, df: DataFrame) -> DataFrame:
        """Unscaled numeric features under their plain names."""
        encoded = self._encode(df, ())
        return encoded.select([F.col(c).alias(c.removeprefix("z_")) for c in encoded.columns])

    def transform(self, df: DataFrame, keep: tuple = ()) -> DataFrame:
        """Scaled features, ``z_<feature>``, after the ``keep`` columns."""
        encoded = self._encode(df, tuple(keep))
        return encoded.select(*keep, *[scaled(F.col(f"z_{c}"), *self.stats[c]).alias(f"z_{c}") for c in self.stats])
