"""Operator names usable in a pipeline spec.

An entry is a function `(inputs, config) -> outputs`; inputs and outputs are dicts of
lazy tables, fitted values and models. Register your own with `register`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import (backtest, dedup, encode, evaluate, forecast, guard, impute, isolation, models, redundancy, sanitize,
                         scale, score, split, stages, timeseries, vectorize, word_vectors)
from ..sources import tables
from . import runs


@dataclass(frozen=True)
class Entry:
    name: str
    category: str
    run: Callable[[dict, dict], dict]
    needs: tuple[str, ...] = ("dataframe",)


_entries: dict[str, Entry] = {}


def register(name: str, category: str, needs: tuple[str, ...] = ("dataframe",)):
    def add(run):
        _entries[name] = Entry(name, category, run, needs)
        return run

    return add


def get(name: str) -> Entry:
    if name not in _entries:
        raise KeyError(f"no operator named {name}")
    return _entries[name]


def names(category: str | None = None) -> list[str]:
    return [e.name for e in _entries.values() if category in (None, e.category)]


def categories() -> list[str]:
    return sorted({e.category for e in _entries.values()})


def _given(config: dict, *keys: str, **renamed: str) -> dict:
    """The listed settings that are present, under the operator's own argument names."""
    out = {k: config[k] for k in keys if config.get(k) is not None}
    out.update({arg: config[k] for arg, k in renamed.items() if config.get(k) is not None})
    return out


@register("csv_loader", "ingestion", needs=())
def _load(inputs, config):
    spark = SparkSession.active()
    path = config.get("storage_path") or config.get("file_path")
    if path:
        return {"dataframe": tables.read_table(spark, path, **_given(config, "delimiter", "schema"))}
    if config.get("dataframe_records"):
        return {"dataframe": tables.from_records(spark, config["dataframe_records"], config.get("schema"))}
    if "dataframe" in inputs:
        return {"dataframe": inputs["dataframe"]}
    return {"dataframe": tables.demo_table(spark)}


@register("webhook_trigger", "triggers", needs=())
def _payload(inputs, config):
    if "dataframe" in inputs:
        return {"dataframe": tables.flatten(inputs["dataframe"])}
    payload = config.get("payload") or []
    records = payload if isinstance(payload, list) else [payload]
    return {"dataframe": tables.flatten(tables.from_records(SparkSession.active(), records, config.get("schema")))}


@register("cron_trigger", "triggers", needs=())
def _scheduled(inputs, config):
    return dict(inputs)


@register("duplicate_remover", "preprocessing")
def _dedup(inputs, config):
    return {"dataframe": dedup.remove_duplicates(
        inputs["dataframe"], **_given(config, "strategy", "subset_columns", "order_by"))}


@register("category_sanitizer", "preprocessing")
def _sanitize(inputs, config):
    return {"dataframe": sanitize.sanitize_categories(
        inputs["dataframe"], **_given(config, "columns", "lowercase", "strip_whitespace", "remove_punctuation"))}


@register("correlation_filter", "preprocessing")
def _correlation(inputs, config):
    return {"dataframe": redundancy.correlation_filter(inputs["dataframe"], **_given(config, "threshold", "method"))}


@register("variance_filter", "preprocessing")
def _variance(inputs, config):
    return {"dataframe": redundancy.variance_filter(inputs["dataframe"], **_given(config, "max_dominant_percentage"))}


@register("missing_value_imputer", "preprocessing")
def _impute(inputs, config):
    df, strategy = inputs["dataframe"], config.get("strategy", "median")
    if strategy in ("mean", "median", "mode", "constant"):
        fills = impute.fit_fills(df, strategy, **_given(config, "columns", "fill_value"))
        return {"dataframe": impute.apply_fills(df, fills), "imputer_stats": fills}
    return {"dataframe": impute.impute(df, strategy, **_given(config, "columns", "order_by", "partition_by")),
            "imputer_stats": {}}


@register("feature_scaler", "preprocessing")
def _scale(inputs, config):
    fitted = scale.fit_scaler(inputs["dataframe"], **_given(config, "method", "columns", "exclude_target"))
    return {"dataframe": scale.apply_scaler(inputs["dataframe"], fitted), "scaler": fitted}


@register("categorical_encoder", "preprocessing")
def _encode(inputs, config):
    fitted = encode.fit_encoder(
        inputs["dataframe"], **{**_given(inputs, "target_column"),
                                **_given(config, "method", "columns", "drop_first", "target_column")})
    return {"dataframe": encode.apply_encoder(inputs["dataframe"], fitted), "encoder": fitted}


@register("text_preprocessor", "nlp")
def _text(inputs, config):
    return {"dataframe": stages.clean_columns(inputs["dataframe"], **_given(
        config, "columns", "lowercase", "strip_html_urls", "remove_punctuation", "remove_numbers", "remove_stopwords",
        "normalization"))}


@register("text_vectorizer", "nlp")
def _vectorize(inputs, config):
    df, method = inputs["dataframe"], config.get("method", "tfidf")
    drop = config.get("drop_original", True)
    if method == "word2vec":
        column, model = vectorize.fit_word2vec(df, config.get("column"), int(config.get("max_features", 50)))
        return {"dataframe": vectorize.word2vec(df, column, model, drop), "vectorizer": model, "text_column": column}
    if method == "neighbours":
        column = vectorize.text_column(df, config.get("column"))
        if column is None:
            return {"dataframe": df}
        found = word_vectors.fit_word_vectors(df, column, int(config.get("max_features", 50)), **_given(config, "window", "shift", "min_count"))
        return {"dataframe": word_vectors.document_vectors(df, column, found, drop), "vectorizer": found, "text_column": column}
    fitted = vectorize.fit_vectorizer(df, **_given(config, "method", "column", "max_features", "ngram_range"))
    if fitted is None:
        return {"dataframe": df}
    return {"dataframe": vectorize.vectorize(df, fitted, drop), "vectorizer": fitted, "text_column": fitted["column"]}


@register("train_test_split", "splitting")
def _split(inputs, config):
    df = inputs["dataframe"]
    target = config.get("target_column") if config.get("target_column") in df.columns else df.columns[-1]
    keys = config.get("key_columns") or df.columns
    marked = split.train_test_split(
        df, keys, float(config.get("test_size", 0.2)), int(config.get("random_state", 42)),
        target if config.get("stratify") else None)
    train, test = split.parts(marked)
    return {"train": train, "test": test, "target_column": target, "dataframe": marked}


def _trainer(name: str):
    @register(name, "training", needs=("train", "target_column"))
    def run(inputs, config):
        trained = models.train_model(inputs["train"], inputs["target_column"], name, config)
        out = {"model": trained, "task_type": trained.task, "feature_importances": trained.importances,
               "feature_names": trained.feature_names, "target_classes": trained.classes}
        if "test" in inputs:
            out["dataframe"] = score.score_batch(inputs["test"], trained)
        return out


for _name in models.ALGORITHMS:
    _trainer(_name)


@register("model_evaluator", "evaluation", needs=())
def _evaluate(inputs, config):
    if "forecast_metrics" in inputs:
        return {"metrics": inputs["forecast_metrics"]}
    if "model" not in inputs:
        raise ValueError("the evaluator lacks a model or a forecast")
    trained: models.TrainedModel = inputs["model"]
    predicted = trained.predict(trained.label_rows(inputs["test"])).withColumn("_label", F.col(trained.label))
    if trained.task != "classification":
        return {"metrics": evaluate.regression_metrics(predicted, "_label", "prediction")}
    scored = predicted.select(
        F.col("_label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
        score.probabilities(predicted).alias("p"))
    threshold = float(config.get("decision_threshold", 0.5))
    binary = len(trained.classes) == 2 if trained.classes else (trained.pipeline.stages[-1].numClasses == 2)
    if binary and threshold != 0.5:
        scored = evaluate.apply_threshold(scored, F.col("p")[1], threshold)
    out = {
        "metrics": evaluate.classification_metrics(scored, average=config.get("average_strategy", "weighted")),
        "confusion": evaluate.confusion(scored),
        "report": evaluate.classification_report(scored),
        "log_loss": evaluate.log_loss(scored, F.get("p", F.col("label"))),
    }
    if binary:
        out["roc_auc"] = evaluate.roc_auc(scored, F.col("label") == 1, F.col("p")[1])
        fp, fn = float(config.get("cost_false_positive", 0)), float(config.get("cost_false_negative", 0))
        if fp > 0 or fn > 0:
            out["business_cost"] = evaluate.business_cost(scored, cost_false_positive=fp, cost_false_negative=fn)
    else:
        known = trained.classes or [str(i) for i in range(trained.pipeline.stages[-1].numClasses)]
        out["roc_auc_ovr"] = evaluate.roc_auc_one_vs_rest(
            scored, "label", {i: F.get("p", F.lit(i)) for i in range(len(known))},
            config.get("average_strategy", "weighted"))
    return out


@register("isolation_forest", "anomaly")
def _isolation(inputs, config):
    fitted = isolation.fit_isolation_forest(
        inputs["dataframe"], **_given(config, "columns", "contamination", "n_estimators", "random_state"))
    flagged = isolation.flag_anomalies(inputs["dataframe"], fitted)
    return {"dataframe": flagged, "model": fitted, "metrics": isolation.anomaly_summary(flagged),
            "task_type": "anomaly_detection"}


@register("statistical_guardrail", "anomaly")
def _guard(inputs, config):
    fitted = guard.fit_bounds(inputs["dataframe"], **_given(config, "method", "threshold", "columns"))
    return {"dataframe": guard.apply_bounds(inputs["dataframe"], fitted, config.get("action", "flag")),
            "metrics": guard.guard_report(inputs["dataframe"], fitted), "bounds": fitted}


@register("lag_feature_engineering", "forecasting")
def _lags(inputs, config):
    return {"dataframe": timeseries.lag_features(inputs["dataframe"], **_given(
        config, "lag_periods", "rolling_windows", "include_calendar_features", "partition_by", "tie_break", "fill",
        date="date_column", target="target_column"))}


def _series(df: DataFrame, config: dict) -> tuple[DataFrame, str, str, list[str]]:
    date = timeseries.date_column(df, config.get("date_column"))
    keys = config.get("partition_by") or []
    target = timeseries.last_numeric(df, config.get("target_column"), exclude=[date, *keys])
    return timeseries.parse_dates(df, date), date, target, keys


def _forecast(out: DataFrame, report: DataFrame, df: DataFrame, config: dict, tested) -> dict:
    """Outputs of a forecaster; with `backtest_origins` also errors on dates it has not seen, per series."""
    result = {"dataframe": out, "forecast_df": out, "task_type": "time_series_forecasting", "metrics": report,
              "forecast_metrics": report}
    if int(config.get("backtest_origins", 0)) > 0:
        result["backtest"] = tested(int(config["backtest_origins"]))
        result["backtest_metrics"] = backtest.backtest_metrics(result["backtest"], config.get("partition_by") or [])
    return result


@register("prophet_forecaster", "forecasting")
def _additive(inputs, config):
    df, date, target, keys = _series(inputs["dataframe"], config)
    horizon, mode = int(config.get("horizon_periods", 14)), config.get("seasonality_mode", "additive")
    out, report = forecast.additive_report(df, date, target, horizon, config.get("frequency", "D (Daily)").split()[0], mode, keys)
    return _forecast(out, report, df, config, lambda origins: backtest.backtest_additive(
        df, date, target, horizon, origins, keys=keys, seasonality_mode=mode))


@register("arima_forecaster", "forecasting")
def _arima(inputs, config):
    df, date, target, keys = _series(inputs["dataframe"], config)
    order, horizon = [int(config.get(n, 1)) for n in "pdq"], int(config.get("horizon_periods", 14))
    out, report = forecast.arima_report(df, date, target, *order, horizon, config.get("frequency", "D").split()[0], keys)
    return _forecast(out, report, df, config, lambda origins: backtest.backtest_arima(
        df, date, target, *order, horizon, origins, keys=keys))


def _metric_values(metrics: DataFrame) -> dict:
    """A one-row table as it is; of several rows (one per series or class) the count and the mean of each number."""
    numbers = [f.name for f in metrics.schema.fields if isinstance(f.dataType, T.NumericType)]
    texts = [c for c in metrics.columns if c not in numbers]
    row = metrics.agg(F.count(F.lit(1)).alias("_rows"), *[F.avg(f"`{c}`").alias(c) for c in numbers],
                      *[F.min(F.col(f"`{c}`").cast("string")).alias(c) for c in texts]).first().asDict()
    rows = row.pop("_rows")
    if rows == 0:
        return {}
    return row if rows == 1 else {"rows": rows, **{c: row[c] for c in numbers}}


@register("mlflow_tracker", "governance", needs=())
def _track(inputs, config):
    metrics = inputs.get("metrics") or {}
    if isinstance(metrics, DataFrame):
        metrics = _metric_values(metrics)
    record = runs.log_run(
        SparkSession.active(), config["tracking_uri"], metrics,
        model=getattr(inputs.get("model"), "pipeline", None),
        **_given(config, "experiment_name", "registered_model_name", "stage"))
    return {"governance_record": record, "metrics": inputs.get("metrics")}
