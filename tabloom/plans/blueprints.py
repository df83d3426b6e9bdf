"""Four whole pipelines: supervised, forecasting, anomaly detection, governed.

Preparation that learns (imputer, scaler, encoder) is fitted on the training rows
only; `fit_on="all"` fits it on the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encode, evaluate, forecast, impute, isolation, models, scale, split
from . import runs


def _prepared(marked: DataFrame, target: str, keys: Sequence[str], fit_on: str, encoder: str | None) -> DataFrame:
    """Imputed, then encoded or scaled; key, target and split columns are left alone."""
    basis = marked.filter(F.col(split.SPLIT) == "train") if fit_on == "train" else marked
    skip = {target, split.SPLIT, *keys}
    names = [c for c in marked.columns if c not in skip]
    fills = impute.fit_fills(basis, "median", names)
    marked, basis = impute.apply_fills(marked, fills), impute.apply_fills(basis, fills)
    if encoder:
        texts = [c for c in names if c in encode.names_of(basis, "non_numeric")]
        return encode.apply_encoder(marked, encode.fit_encoder(basis, encoder, texts)) if texts else marked
    numeric = [c for c in scale.scalable_columns(basis.select(*[F.col(f"`{n}`") for n in names]))]
    return scale.apply_scaler(marked, scale.fit_scaler(basis, "standard", numeric)) if numeric else marked


def _train_and_score(prepared: DataFrame, target: str, keys: Sequence[str], algorithm: str, config: dict):
    train, test = split.parts(prepared)
    trained = models.train_model(train.drop(*keys), target, algorithm, config)
    predicted = trained.predict(trained.label_rows(test))
    return trained, predicted.select(
        *keys, F.col(f"`{target}`").cast("double").alias("label"), F.col("prediction"))


def supervised(df: DataFrame, target: str, keys: Sequence[str], task_type: str = "classification",
               algorithm: str = "xgboost_trainer", config: dict | None = None, test_size: float = 0.2,
               fit_on: str = "train") -> tuple[models.TrainedModel, DataFrame]:
    """Median imputation, standard scaling, split, boosted trees: (model, test predictions)."""
    marked = split.train_test_split(df, keys, test_size)
    prepared = _prepared(marked, target, keys, fit_on, encoder=None)
    return _train_and_score(prepared, target, keys, algorithm, {**(config or {}), "task_type": task_type})


def forecasting(df: DataFrame, date: str, target: str, horizon: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Forward fill in date order, then trend and seasonality with a horizon."""
    filled = impute.impute(df, "ffill", [target], order_by=[date], partition_by=keys)
    return forecast.additive_forecast(filled, date, target, horizon, keys=keys)


def anomaly(df: DataFrame, columns: Sequence[str], contamination: float = 0.05, n_estimators: int = 100) -> DataFrame:
    """Median imputation, then isolation forest over the given columns."""
    filled = impute.impute(df, "median", columns)
    fitted = isolation.fit_isolation_forest(filled, columns, contamination, n_estimators)
    return isolation.flag_anomalies(filled, fitted)


def governed(df: DataFrame, target: str, keys: Sequence[str], tracking_uri: str, config: dict | None = None,
             test_size: float = 0.2, fit_on: str = "train", stage: str = "Staging") -> tuple[dict, DataFrame]:
    """Imputer, one-hot encoder, split, boosted trees with native categories, metrics, run record."""
    marked = split.train_test_split(df, keys, test_size)
    prepared = _prepared(marked, target, keys, fit_on, encoder="one_hot")
    trained, predicted = _train_and_score(prepared, target, keys, "catboost_trainer",
                                          {**(config or {}), "task_type": "classification"})
    metrics = evaluate.classification_metrics(predicted)
    record = runs.log_run(df.sparkSession, tracking_uri, {**metrics.first().asDict(), "task_type": trained.task},
                          model=trained.pipeline, stage=stage)
    return record, metrics
