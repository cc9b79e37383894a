"""Append-only Parquet tables of datasets, analyses and predictions, and their queries."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tabcast.operators import order

DATASETS = (
    "dataset_id string, owner string, filename string, n_rows bigint, n_cols int, column_names array<string>, "
    "column_types map<string,string>, column_stats map<string,struct<mean:double,std:double,min:double,max:double,"
    "median:double,n_unique:bigint,nulls:bigint,top3:array<string>>>, "
    "correlation array<struct<c1:string,c2:string,r:double>>, uploaded_at timestamp"
)
ANALYSES = (
    "analysis_id string, owner string, dataset_id string, filename string, model_type string, target_col string, "
    "feature_cols array<string>, r2 double, mse double, mae double, rmse double, cv_r2_mean double, cv_r2_std double, "
    "test_size double, n_train bigint, n_test bigint, model_params map<string,string>, "
    "feature_importances map<string,double>, model_path string, additional_info string, created_at timestamp"
)
PREDICTIONS = (
    "prediction_id string, analysis_id string, owner string, step int, input_values map<string,string>, "
    "predicted double, ci_low double, ci_high double, label string, created_at timestamp"
)


class RunStore:
    """The three run tables under one folder; owners are partitions, so an owner's history prunes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _append(self, rows: DataFrame, table: str) -> None:
        rows.write.mode("append").partitionBy("owner").parquet(f"{self.root}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def datasets(self) -> DataFrame:
        return self._read("datasets", DATASETS)

    def analyses(self) -> DataFrame:
        return self._read("analyses", ANALYSES)

    def predictions(self) -> DataFrame:
        return self._read("predictions", PREDICTIONS)

    def has(self, table: str) -> bool:
        """True once something was saved to a table."""
        try:
            self.spark.read.schema("owner string").parquet(f"{self.root}/{table}")
        except AnalysisException:
            return False
        return True

    def model_path(self) -> str:
        return f"{self.root}/models/{uuid.uuid4()}"

    def save_dataset(
        self, owner: str, filename: str, n_rows: int, types: dict[str, str],
        numeric: DataFrame | None, categorical: DataFrame | None, pairs: DataFrame | None,
    ) -> str:
        """Profile tables (one row per column or pair) gathered into one nested row."""
        dataset_id = str(uuid.uuid4())
        stats = _stats_entries(numeric, categorical)
        row = self.spark.createDataFrame(
            [(dataset_id, owner, filename, n_rows, len(types), list(types), types)],
            "dataset_id string, owner string, filename string, n_rows bigint, n_cols int, "
            "column_names array<string>, column_types map<string,string>",
        )
        if stats is not None:
            # One row holding one entry per column: no larger than the schema.
            gathered = stats.groupBy(F.lit(dataset_id).alias("dataset_id")).agg(
                F.map_from_entries(F.collect_list("entry")).alias("column_stats"))
            row = row.join(gathered, "dataset_id", "left")
        if pairs is not None:
            gathered = pairs.groupBy(F.lit(dataset_id).alias("dataset_id")).agg(
                F.collect_list(F.struct("c1", "c2", F.round("r", 4).alias("r"))).alias("correlation"))
            row = row.join(gathered, "dataset_id", "left")
        row = row.withColumn("uploaded_at", F.current_timestamp())
        self._append(_conform(row, DATASETS), "datasets")
        return dataset_id

    def save_analysis(self, owner: str, **fields) -> str:
        """One training run; field names are those of the analyses table."""
        analysis_id = str(uuid.uuid4())
        names = {f.name: f for f in _fields(ANALYSES)}
        unknown = set(fields) - set(names)
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        values = {"analysis_id": analysis_id, "owner": owner, **fields}
        given = [f for name, f in names.items() if name in values]
        row = self.spark.createDataFrame([tuple(values[f.name] for f in given)], StructType(given))
        if "created_at" not in values:
            row = row.withColumn("created_at", F.current_timestamp())
        self._append(_conform(row, ANALYSES), "analyses")
        return analysis_id

    def save_predictions(self, scored: DataFrame, owner: str, analysis_id: str, label: str, inputs: list[str] = ()) -> None:
        """Every step of a scored scenario table."""
        columns = [x for c in inputs for x in (F.lit(c), F.col(c).cast("string"))]
        step = F.col("step") if "step" in scored.columns else F.lit(0)
        rows = scored.select(
            F.expr("uuid()").alias("prediction_id"), F.lit(analysis_id).alias("analysis_id"), F.lit(owner).alias("owner"),
            step.cast("int").alias("step"),
            (F.create_map(*columns) if columns else F.expr("map()")).cast("map<string,string>").alias("input_values"),
            F.col("pred").cast("double").alias("predicted"), "ci_low", "ci_high",
            F.lit(label).alias("label"), F.current_timestamp().alias("created_at"),
        )
        self._append(_conform(rows, PREDICTIONS), "predictions")

    def analysis(self, analysis_id: str):
        """The row of one analysis."""
        row = self.analyses().where(F.col("analysis_id") == analysis_id).first()
        if row is None:
            raise KeyError(analysis_id)
        return row

    def restore_types(self, dataset_id: str) -> dict[str, str]:
        """Column types stored with an earlier dataset."""
        row = self.datasets().where(F.col("dataset_id") == dataset_id).select("column_types").first()
        return dict(row[0]) if row else {}


def _fields(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _conform(rows: DataFrame, ddl: str) -> DataFrame:
    """All columns of the table in order; those not given are null."""
    fields = _fields(ddl)
    return rows.select([
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])


def _stats_entries(numeric: DataFrame | None, categorical: DataFrame | None) -> DataFrame | None:
    numbers = ("mean", "std", "min", "max", "median")
    parts = []
    for table in (numeric, categorical):
        if table is None:
            continue
        tops = [F.col(c) for c in ("top1", "top2", "top3") if c in table.columns]
        stats = F.struct(
            *[(F.col(c) if c in table.columns else F.lit(None).cast("double")).alias(c) for c in numbers],
            F.col("n_unique"), F.col("nulls"),
            (F.array_compact(F.array(*tops)) if tops else F.lit(None).cast("array<string>")).alias("top3"),
        )
        parts.append(table.select(F.struct("column", stats).alias("entry")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def types_long(datasets: DataFrame) -> DataFrame:
    """Stored types as rows (dataset_id, column, type)."""
    return datasets.select("dataset_id", F.explode("column_types").alias("column", "type"))


def profile_json(datasets: DataFrame) -> DataFrame:
    """Nested profile columns as JSON text, for export."""
    return datasets.select(
        "dataset_id",
        *[F.to_json(c).alias(c) for c in ("column_names", "column_types", "column_stats", "correlation")],
    )


def types_from_json(df: DataFrame, column: str = "column_types") -> DataFrame:
    """Exported types read back as a map column."""
    return df.withColumn(column, F.from_json(column, "map<string,string>"))


def _owned(df: DataFrame, owner: str | None) -> DataFrame:
    return df if owner is None else df.where(F.col("owner") == owner)


def _latest(df: DataFrame, time: str, key: str, limit: int) -> DataFrame:
    """Newest rows of each owner; every task keeps ``limit`` per owner before the shuffle."""
    newest = Window.partitionBy("owner").orderBy(F.desc(time), key)
    return df.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit)


def recent_datasets(datasets: DataFrame, owner: str | None = None, limit: int = 20) -> DataFrame:
    """Newest datasets of one owner, or of every owner."""
    return _latest(_owned(datasets, owner), "uploaded_at", "dataset_id", limit)


def best_model(analyses: DataFrame, owner: str | None = None, target: str | None = None) -> DataFrame:
    """Analysis of the highest R2 per owner and target, the smallest id on ties; a null R2 comes last."""
    rows = _owned(analyses, owner)
    if target is not None:
        rows = rows.where(F.col("target_col") == target)
    others = [c for c in rows.columns if c not in ("owner", "target_col")]
    rank = F.struct(F.col("r2").isNull(), -F.col("r2"), F.col("analysis_id"))
    best = rows.groupBy("owner", "target_col").agg(F.min_by(F.struct(*others), rank).alias("best"))
    return best.select("owner", "target_col", "best.*")


def analysis_log(analyses: DataFrame, owner: str | None = None) -> DataFrame:
    """All analyses, newest first; missing or zero metrics read as a dash."""
    rows = _owned(analyses, owner)
    shown = {
        f"{m}_text": F.when(F.col(m).isNull() | (F.col(m) == 0), "—").otherwise(F.format_string("%.4f", m))
        for m in ("r2", "mse", "mae", "cv_r2_mean") if m in rows.columns
    }
    return rows.withColumns(shown).orderBy(F.desc("created_at"), "analysis_id")


def prediction_log(predictions: DataFrame, analyses: DataFrame, owner: str | None = None, limit: int = 50) -> DataFrame:
    """Newest predictions with the model they came from; those without an analysis drop out."""
    models = analyses.select("analysis_id", "model_type", "target_col")
    joined = order.lookup(_owned(predictions, owner), models, "analysis_id", "inner")
    return _latest(joined, "created_at", "prediction_id", limit)


def target_history(analyses: DataFrame, owner: str | None = None, target: str | None = None) -> DataFrame:
    """Scores of a target in time order."""
    rows = _owned(analyses, owner)
    if target is not None:
        rows = rows.where(F.col("target_col") == target)
    keep = [c for c in ("owner", "target_col", "analysis_id", "model_type", "r2", "cv_r2_mean", "created_at") if c in rows.columns]
    return rows.select(*keep).orderBy("created_at", "analysis_id")


def target_summary(analyses: DataFrame) -> DataFrame:
    """Runs, best R2 (missing counts as 0) and its model per owner and target, with the automatic choice."""
    score = F.coalesce("r2", F.lit(0.0))
    found = analyses.groupBy("owner", "target_col").agg(
        F.count(F.lit(1)).alias("n_runs"), F.max(score).alias("best_r2"),
        F.min_by("model_type", F.struct(-score, F.col("analysis_id"))).alias("best_model"),
    )
    return found.withColumn("recommended", auto_choice(F.col("n_runs")))


def auto_choice(n_runs):
    """Algorithm by the number of earlier runs: ridge from three on, forest before."""
    return F.when(n_runs >= 3, "ridge").otherwise("forest")


def choose_algorithm(history: DataFrame, rule: str = "count") -> str:
    """``count`` goes by the number of runs; ``best`` repeats the model type of the top R2."""
    if rule == "best":
        best = history.where("r2 is not null").orderBy(F.desc("r2"), "analysis_id").select("model_type").first()
        if best:
            return best[0]
    return "ridge" if history.count() >= 3 else "forest"
