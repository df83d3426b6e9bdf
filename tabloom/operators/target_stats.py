"""Ordered target statistics: categories as numbers, without a limit of levels and without leaking the label.

Training rows follow a hash of their features. A row's statistic for a class is the share
of that class among the rows *before* it with the same level, drawn towards the class's
overall share by `strength` rows; its own label never enters. New rows get the share over
all training rows of the level. With two classes there is one column per category, with k
classes k - 1, with a numeric target the mean of the target.

The shares before a row are running sums per level (`ordered.running_sums`), so a level
that fills most of the table is cut into ranges. Levels are a written table, joined on and
broadcast only up to a checked number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .encode import BROADCAST_LEVELS
from .ordered import MAX_TASK_ROWS, running_sums


def _targets(label: str, classes: int) -> list[Column]:
    y = F.col(f"`{label}`")
    return [(y == k).cast("double") for k in range(1, max(classes, 2))] if classes else [y.cast("double")]


def stat_names(column: str, state: dict) -> list[str]:
    return [f"_stat_{column}_{i}" for i in range(len(state["prior"]))]


def _share(total: Column, n: Column, prior: float, strength: float) -> Column:
    return (total + F.lit(prior * strength)) / (n + F.lit(strength))


def fit_target_stats(train: DataFrame, label: str, columns: Sequence[str], classes: int = 0, strength: float = 1.0) -> dict:
    """The levels of each column with rows and summed targets, written; `classes` 0 is a numeric target."""
    ys = _targets(label, classes)
    prior = train.agg(*[F.avg(y).alias(f"p{i}") for i, y in enumerate(ys)]).first() if columns else []
    state = {"prior": [float(p or 0.0) for p in prior], "strength": strength, "columns": {}}
    for c in columns:
        levels = train.groupBy(F.col(f"`{c}`").cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(f"s{i}") for i, y in enumerate(ys)])
        path = shared_folder(train.sparkSession, "levels")
        levels.filter("value IS NOT NULL").write.parquet(path)
        state["columns"][c] = {"table": path, "rows": train.sparkSession.read.parquet(path).count()}
    return state


def training_stats(train: DataFrame, label: str, state: dict, classes: int = 0, seed: int = 42, max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """The training rows with the statistics of the rows before them."""
    ys = _targets(label, classes)
    features = [F.col(f"`{c}`") for c in train.columns if c != label]
    out = train.withColumn("_draw", F.xxhash64(F.lit(seed), *features))
    for c in state["columns"]:
        sums = {"_n": F.lit(1.0), **{f"_s{i}": y for i, y in enumerate(ys)}}
        out = running_sums(out, sums, ["_draw"], [c], max_task_rows)
        out = out.withColumns({name: _share(F.col(f"_s{i}"), F.col("_n"), state["prior"][i], state["strength"])
                               for i, name in enumerate(stat_names(c, state))}).drop(*sums)
    return out.drop("_draw")


def apply_target_stats(df: DataFrame, state: dict) -> DataFrame:
    """New rows with the statistics over all training rows; an unseen level gets the overall share."""
    out = df
    for c, step in state["columns"].items():
        table = df.sparkSession.read.parquet(step["table"]).withColumnsRenamed({"value": "_value", "n": "_n"})
        table = F.broadcast(table) if step["rows"] <= BROADCAST_LEVELS else table
        joined = out.join(table, F.col(f"`{c}`").cast("string") == F.col("_value"), "left")
        out = joined.withColumns({
            name: _share(F.coalesce(f"s{i}", F.lit(0.0)), F.coalesce("_n", F.lit(0)), state["prior"][i], state["strength"])
            for i, name in enumerate(stat_names(c, state))}).drop("_value", "_n", *[f"s{i}" for i in range(len(state["prior"]))])
    return out
