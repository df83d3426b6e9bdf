"""Run tables: appended Parquet tables of runs, metrics, parameters and step telemetry."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Stages a registered model can be in.
STAGES = ("Staging", "Production", "Archived", "None")
RUN_SCHEMA = (
    "run_id string, experiment_name string, registered_model_name string, stage string, metrics_logged int, "
    "model_path string, started_at timestamp"
)


def _folder(uri: str, table: str) -> str:
    return f"{uri.rstrip('/')}/{table}"


def log_run(
    spark: SparkSession, tracking_uri: str, metrics: Mapping[str, object], model=None,
    experiment_name: str = "pipelines", registered_model_name: str = "champion_model", stage: str = "Staging",
) -> dict:
    """Append one run. Numbers are metrics, texts parameters; a fitted Spark ML model is saved beside it."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    run_id = uuid.uuid4().hex
    numbers = [(run_id, k, float(v)) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    texts = [(run_id, k, v) for k, v in metrics.items() if isinstance(v, str)]
    model_path = None
    if model is not None:
        model_path = _folder(tracking_uri, f"models/{registered_model_name}/{run_id}")
        model.write().save(model_path)
    record = {
        "run_id": run_id, "experiment_name": experiment_name, "registered_model_name": registered_model_name,
        "stage": stage, "metrics_logged": len(metrics), "model_path": model_path,
        "started_at": dt.datetime.now(dt.timezone.utc),
    }
    spark.createDataFrame([tuple(record.values())], RUN_SCHEMA).write.mode("append").parquet(_folder(tracking_uri, "runs"))
    for table, rows, kind in (("run_metrics", numbers, "double"), ("run_params", texts, "string")):
        if rows:
            spark.createDataFrame(rows, f"run_id string, name string, value {kind}").write.mode("append").parquet(
                _folder(tracking_uri, table))
    return record


def run_history(spark: SparkSession, tracking_uri: str, limit: int = 50) -> DataFrame:
    """Newest runs first."""
    runs = spark.read.schema(RUN_SCHEMA).parquet(_folder(tracking_uri, "runs"))
    return runs.orderBy(F.col("started_at").desc(), "run_id").limit(limit)


def run_metrics(spark: SparkSession, tracking_uri: str) -> DataFrame:
    return spark.read.schema("run_id string, name string, value double").parquet(_folder(tracking_uri, "run_metrics"))


def observed(df: DataFrame, step: str) -> tuple[DataFrame, Observation]:
    """Count the rows of a step while it runs: no extra pass over the data."""
    watch = Observation(step)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch


def log_steps(spark: SparkSession, tracking_uri: str, run_id: str, steps: list[dict]) -> None:
    """Append step telemetry: step, operator, milliseconds, rows, number of columns."""
    schema = "run_id string, step string, recipe_id string, duration_ms double, output_rows long, n_features int"
    rows = [(run_id, s["step"], s["recipe_id"], s["duration_ms"], s["output_rows"], s["n_features"]) for s in steps]
    spark.createDataFrame(rows, schema).write.mode("append").parquet(_folder(tracking_uri, "run_steps"))


def step_telemetry(spark: SparkSession, tracking_uri: str) -> DataFrame:
    """Runs, mean and longest time, and rows per operator."""
    steps = spark.read.parquet(_folder(tracking_uri, "run_steps"))
    return steps.groupBy("recipe_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
        F.sum("output_rows").alias("output_rows"), F.max("n_features").alias("n_features"),
    )
