"""The three workflows: profile a dataset, train a model, predict scenarios."""

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.functions import values
from tabcast.functions.words import BINARY_WORDS
from tabcast.operators import assoc, encode, evaluate, linear, profile, scenario, trees, typing
from tabcast.operators.encode import Preprocessor
from tabcast.sources import runs, tables

ALGORITHMS = ("auto", "linear", "ridge", "forest", "boosting")
RIDGE_ALPHA = 1.0


@dataclass
class Profile:
    """What is known of a dataset; every table is lazy but ``types``."""

    types: dict[str, str]
    explored: DataFrame
    numeric: DataFrame | None
    categorical: DataFrame | None
    pairs: DataFrame | None
    dataset_id: str | None = None


def profile_dataset(df: DataFrame, store: runs.RunStore | None = None, owner: str = "", filename: str = "", exact: bool = True) -> Profile:
    """Types, column statistics and correlations; saved as one dataset when a store is given."""
    df = values.nan_to_null(df)
    types = typing.type_map(typing.decide_types(df))
    numbers = tables.numeric_columns(df)
    others = [f.name for f in typing.typed_fields(df) if f.name not in numbers]
    found = Profile(
        types, typing.explore_table(df, exact),
        profile.profile_numeric(df, numbers, exact=exact) if numbers else None,
        profile.profile_categorical(df, others) if others else None,
        assoc.raw_pairs(df, numbers) if len(numbers) > 1 else None,
    )
    if store is not None:
        found.dataset_id = store.save_dataset(owner, filename, df.count(), types, found.numeric, found.categorical, found.pairs)
    return found


@dataclass
class Trained:
    """A fitted preprocessing and model with its scores."""

    target: str
    algorithm: str
    prep: Preprocessor
    model: object
    metrics: dict
    cv: dict
    n_train: int
    n_test: int
    dropped: int
    y_range: float
    scored: DataFrame
    importances: dict[str, float] = field(default_factory=dict)
    analysis_id: str | None = None

    def score(self, raw: DataFrame, keep: tuple = (), intervals: bool = True) -> DataFrame:
        """Predictions for raw rows: ``keep``, pred, ci_low, ci_high.

        A forest's interval comes from its trees; the others use the test error.
        """
        rows = self.prep.transform(raw, tuple(keep))
        if self.algorithm in ("linear", "ridge"):
            rows = rows.withColumn("pred", self.model.predict())
        else:
            rows = trees.assemble(rows, self.prep.outputs)
            if intervals and self.algorithm == "forest":
                return trees.tree_interval(self.model, rows).select(*keep, "pred", "ci_low", "ci_high")
            rows = self.model.transform(rows)
        rows = rows.select(*keep, "pred")
        return scenario.rmse_interval(rows, self.metrics["rmse"]) if intervals else rows


def as_target(df: DataFrame, target: str) -> DataFrame:
    """Target as a number: texts that hold binary words become codes in text order."""
    if df.schema[target].dataType.simpleString() == "boolean":
        return df.withColumn(target, F.col(target).cast("double"))
    if values.is_number_type(df.schema[target].dataType):
        return df.withColumn(target, F.col(target).cast("double"))
    word = values.normalise_text(F.col(target))
    found = df.select(word.alias("w")).where(F.col("w").isin(*BINARY_WORDS)).distinct().orderBy("w")
    labels = [r["w"] for r in found.collect()]  # at most the fixed binary words
    code = values.to_number(F.col(target))
    if any(not label.isdigit() for label in labels):
        code = F.lit(None).cast("double")
        for i, label in enumerate(labels):
            code = F.when(word == label, float(i)).otherwise(code)
    return df.withColumn(target, code)


def train(
    df: DataFrame, target: str, key: str, types: dict[str, str] | None = None, algorithm: str = "auto",
    test: float = 0.2, folds: int = 5, seed: int = 42, fit_scope: str = "train", label_order: dict | None = None,
    store: runs.RunStore | None = None, owner: str = "", dataset_id: str | None = None, filename: str = "",
    auto: str = "count", trees_count: int = trees.TREES, depth: int = 10,
) -> Trained:
    """Fit one regressor, score it on held-out rows, cross-validate it, and save the run.

    ``key`` is unique and orders rows for the split and the folds.
    ``fit_scope="all"`` learns the encoders and the scaling from all rows, as
    a plain notebook would; the default learns them from the training rows.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    df = values.nan_to_null(df)
    types = types or typing.type_map(typing.decide_types(df))
    total = df.count()
    rows = evaluate.split(as_target(df, target).where(F.col(target).isNotNull()), key, test, seed)
    prep = Preprocessor(types, key, label_order)
    prep.fit(rows.drop("is_test") if fit_scope == "all" else rows.where("not is_test").drop("is_test"), target)
    ready = evaluate.kfold(prep.transform(rows, (key, target, "is_test")), key, folds)
    # Read by the fit, every fold and the metrics; lost blocks are computed again.
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    training, held = ready.where("not is_test"), ready.where("is_test")
    history = None
    if algorithm == "auto":
        if store is not None and store.has("analyses"):
            history = runs.target_history(store.analyses(), owner, target)
        algorithm = runs.choose_algorithm(history, auto) if history is not None else "forest"
    if algorithm in ("linear", "ridge"):
        alpha = RIDGE_ALPHA if algorithm == "ridge" else 0.0
        model = linear.fit_linear(training, prep.outputs, target, alpha)
        scored = held.select(key, target, model.predict().alias("pred"))
        cv_scores = linear.cross_validate(ready, prep.outputs, target, "fold", alpha)
        weights = model.coef
    else:
        make = trees.forest if algorithm == "forest" else trees.boosting
        estimator = make(target, trees_count, depth if algorithm == "forest" else 3)
        vectors = trees.assemble(ready, prep.outputs)
        model = trees.fit(estimator, vectors.where("not is_test"))
        scored = model.transform(vectors.where("is_test")).select(key, target, "pred")
        cv_scores = trees.cross_validate(vectors, target, "fold", estimator)
        weights = model.featureImportances.toArray()
    score = evaluate.metrics_banded(scored, target, "pred").first().asDict()
    cv = evaluate.cv_summary(cv_scores).first().asDict()
    n_train = training.count()
    ready.unpersist()
    names = [c.removeprefix("z_") for c in prep.outputs]
    result = Trained(
        target, algorithm, prep, model, score, cv, n_train, score["n"], total - n_train - score["n"], score["y_range"], scored,
        {name: abs(float(w)) for name, w in zip(names, weights)},
    )
    if store is not None:
        result.analysis_id = _save(result, store, owner, dataset_id, filename, test, folds)
    return result


def _save(result: Trained, store: runs.RunStore, owner: str, dataset_id: str | None, filename: str, test: float, folds: int) -> str:
    path, params = save_model(store, result.model)
    found = {name: _finite(result.metrics[name]) for name in ("r2", "mse", "mae", "rmse")}
    return store.save_analysis(
        owner, dataset_id=dataset_id, filename=filename, model_type=result.algorithm, target_col=result.target,
        feature_cols=list(result.importances), **found, cv_r2_mean=_finite(result.cv["cv_r2_mean"]),
        cv_r2_std=_finite(result.cv["cv_r2_std"]), test_size=test, n_train=result.n_train, n_test=result.n_test,
        model_params=params, feature_importances={k: round(v, 6) for k, v in result.importances.items()},
        model_path=path, additional_info=f"folds={folds}, test={test:.0%}",
    )


def save_model(store: runs.RunStore, model) -> tuple[str | None, dict[str, str]]:
    """Where a tree model was written, or the numbers of a linear one."""
    if isinstance(model, linear.LinearFit):
        params = {f"coef_{f}": repr(float(w)) for f, w in zip(model.features, model.coef)}
        return None, params | {"intercept": repr(float(model.intercept))}
    path = store.model_path()
    model.write().save(path)
    return path, {}


def load_model(store: runs.RunStore, analysis_id: str):
    """The model of a saved analysis, read back from its row: a ``LinearFit``, or a tree model from its stored path."""
    row = store.analysis(analysis_id)
    if row["model_type"] in ("linear", "ridge"):
        weights = {k.removeprefix("coef_"): float(v) for k, v in row["model_params"].items() if k.startswith("coef_")}
        names = sorted(weights)
        return linear.LinearFit(names, np.array([weights[n] for n in names]), float(row["model_params"]["intercept"]), None)
    reader = {"forest": RandomForestRegressionModel, "boosting": GBTRegressionModel}[row["model_type"]]
    return reader.load(row["model_path"])


def predict_saved(store: runs.RunStore, analysis_id: str, prepared: DataFrame, features: list[str]) -> DataFrame:
    """Add ``pred`` by a saved analysis to rows whose feature columns are prepared; order them as at training."""
    model = load_model(store, analysis_id)
    if isinstance(model, linear.LinearFit):
        if set(model.features) != set(features):
            raise ValueError(f"the model has features {model.features}")
        return prepared.withColumn("pred", model.predict())
    return model.transform(trees.assemble(prepared, features)).drop("features")


def _finite(value: float | None) -> float | None:
    return None if value is None or not math.isfinite(value) else float(value)


def predict_what_if(trained: Trained, df: DataFrame, overrides: DataFrame, keep: tuple, by: str | None = None) -> DataFrame:
    """Scores of explicit scenarios; what a scenario leaves out comes from the baseline."""
    base = scenario.baseline(df, trained.prep.inputs, [by] if by else None)
    return trained.score(scenario.what_if(base, overrides, by), keep)


def predict_sweep(
    trained: Trained, df: DataFrame, column: str, low: float | None = None, high: float | None = None,
    steps: int = 50, by: list[str] | None = None,
) -> DataFrame:
    """Scores along the range of one feature, the rest at its baseline."""
    if low is None or high is None:
        limits = profile.range_defaults(df, [column]).first()
        low, high = (limits["low"] if low is None else low), (limits["high"] if high is None else high)
    rows = scenario.sweep(scenario.baseline(df, trained.prep.inputs, by), column, low, high, steps)
    rows = rows.withColumn("x", F.col(column))
    return trained.score(rows, (*(by or []), "step", "x"))


def predict_future(
    trained: Trained, df: DataFrame, date_column: str, n: int = 12, unit: str = "month", start: str | None = None,
    by: list[str] | None = None, calendar: bool = False,
) -> DataFrame:
    """Scores of the next ``n`` periods after ``start``, by default the last date of the data (of each group)."""
    base = scenario.baseline(df, trained.prep.inputs, by)
    stamp = values.as_timestamp(F.col(date_column), df.schema[date_column].dataType)
    if start is not None:
        base = base.withColumn("_start", F.to_date(F.lit(start)))
    elif by:
        last = df.groupBy(*by).agg(F.to_date(F.max(stamp)).alias("_start"))
        last = last.select(*[F.col(g).alias(f"_g_{g}") for g in by], "_start")
        base = base.join(last, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in by], "left")
    else:
        base = base.withColumn("_start", F.lit(df.agg(F.to_date(F.max(stamp))).first()[0]))
    rows = scenario.project(base, trained.prep.types, F.col("_start"), n, unit, calendar)
    return trained.score(rows, (*(by or []), "step", "at"))


def scaled_features(df: DataFrame, types: dict[str, str], target: str, key: str) -> DataFrame:
    """Features of all rows by preprocessing fitted on them, after the key."""
    prep = encode.Preprocessor(types, key).fit(df, target)
    return prep.transform(df, (key,))
