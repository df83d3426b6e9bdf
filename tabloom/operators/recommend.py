"""Rules over a column profile: target, task, preparation steps, and ranked models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import RECOMMENDER_TARGET_WORDS, is_datetime
from .profile import profile_lines

TASKS = ("classification", "regression", "time_series_forecasting", "anomaly_detection")
# Borders between a class label and a measured number.
CONTINUOUS_LEVELS, CLASS_LEVELS, CLASS_SHARE = 20, 10, 0.1


def choose_target(names: list[str], date_columns: list[str], target_column: str | None = None) -> str:
    if target_column and target_column in names:
        return target_column
    candidates = [n for n in names if n not in date_columns]
    named = [n for n in candidates if any(w in n.lower() for w in RECOMMENDER_TARGET_WORDS)]
    return (named or candidates[-1:] or names[-1:])[0]


def _task(kind: str, unique: int, rows: int, fractional: bool, has_date: bool) -> str:
    if has_date and kind == "numeric":
        return "time_series_forecasting"
    if kind in ("categorical", "text", "boolean") or unique == 2:
        return "classification"
    if kind != "numeric":
        return "anomaly_detection"
    if fractional or unique > CONTINUOUS_LEVELS:
        return "regression"
    return "classification" if unique <= CLASS_LEVELS and unique < rows * CLASS_SHARE else "regression"


def recommend(df: DataFrame, target_column: str | None = None, task_type: str | None = None, approximate: bool = False) -> dict:
    """Target, task, profile summary and the list of preparation steps.

    Of the numeric columns only the target's distinct values are counted.
    """
    likely = choose_target(df.columns, [f.name for f in df.schema.fields if is_datetime(f.dataType)], target_column)
    rows, profile = profile_lines(df, approximate, quantiles=False, distinct=[likely])
    columns = {r["name"]: r for r in profile}
    names = list(columns) or df.columns
    dates = [n for n, r in columns.items() if r["inferred_type"] == "datetime"]
    cats = [n for n, r in columns.items() if r["inferred_type"] == "categorical"]
    nums = [n for n, r in columns.items() if r["inferred_type"] == "numeric"]
    target = choose_target(names, dates, target_column)
    meta = columns.get(target)
    if task_type in TASKS:
        task = task_type
    elif meta is None:
        task = "anomaly_detection"
    else:
        task = _task(meta["inferred_type"], meta["unique_count"], rows, meta["fractional"], bool(dates))
    missing = sum(r["null_count"] for r in profile)
    steps = []
    if missing:
        steps.append(("missing_value_imputer", "strategy", "median"))
    if [c for c in cats if c != target]:
        steps.append(("categorical_encoder", "method", "one_hot"))
    if [c for c in nums if c != target]:
        steps.append(("feature_scaler", "method", "standard"))
    return {
        "target_column": target,
        "task_type": task,
        "profile_summary": {
            "rows": rows, "columns": len(columns), "missing_cells": missing, "categorical_columns": len(cats),
            "numeric_columns": len(nums), "date_columns": len(dates),
        },
        "steps": [{"recipe_id": r, "config": {k: v}} for r, k, v in steps],
    }


def recommendation_row(df: DataFrame, name: str, **options) -> DataFrame:
    """The recommendation as one row: target, task and profile summary."""
    r = recommend(df, **options)
    line = {"table_name": name, "target_column": r["target_column"], "task_type": r["task_type"], **r["profile_summary"]}
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in line.items())
    return df.sparkSession.createDataFrame([tuple(line.values())], schema)


def recommendation_steps(df: DataFrame, name: str, **options) -> DataFrame:
    """`(table_name, step, recipe_id, setting, value)` rows of the preparation chain."""
    lines = [
        (name, i, s["recipe_id"], k, v)
        for i, s in enumerate(recommend(df, **options)["steps"]) for k, v in s["config"].items()
    ]
    return df.sparkSession.createDataFrame(lines, "table_name string, step int, recipe_id string, setting string, value string")


def rank_models(runs: DataFrame, metric: str, higher_is_better: bool = True, task: str = "task_type") -> DataFrame:
    """Candidates of each task ranked by a measured metric; rank 1 is the champion."""
    value = F.col(metric)
    w = Window.partitionBy(task).orderBy(value.desc_nulls_last() if higher_is_better else value.asc_nulls_last(), "model")
    return runs.withColumn("rank", F.row_number().over(w)).withColumn("is_champion", F.col("rank") == 1)
