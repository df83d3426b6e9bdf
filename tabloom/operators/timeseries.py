"""Lag, rolling and calendar features; date spine and spacing of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import date_column, int_list, last_numeric
from ..functions.dates import as_timestamp, calendar, future_steps, step_interval
from .impute import fill_rest
from .ordered import MAX_TASK_ROWS, arrange, bounded_window, fill_arranged, sort_keys, window_arranged

DEFAULT_LAGS = "1, 2, 3, 7, 14"
DEFAULT_WINDOWS = "7, 14"


def parse_dates(df: DataFrame, column: str) -> DataFrame:
    """The column as a timestamp, null where it cannot be read."""
    return df.withColumn(column, as_timestamp(F.col(f"`{column}`"), df.schema[column].dataType))


def lag_features(
    df: DataFrame,
    date: str | None = None,
    target: str | None = None,
    lag_periods=DEFAULT_LAGS,
    rolling_windows=DEFAULT_WINDOWS,
    include_calendar_features: bool = True,
    partition_by: Sequence[str] = (),
    tie_break: Sequence[str] = (),
    fill: str = "backfill",
    max_task_rows: int = MAX_TASK_ROWS,
) -> DataFrame:
    """Lags, and mean and sample deviation of the previous `w` rows, in date order per series.

    `fill="backfill"` takes the next known value for every null, then 0; `"none"`
    leaves the nulls. `tie_break` orders rows of the same date; what it leaves equal follows
    a hash of the row. All steps share one count and, for large series, one set of ranges.
    """
    date = date_column(df, date)
    target = last_numeric(df, target, exclude=[date]) or df.columns[-1]
    parsed = parse_dates(df, date)
    order = [date, *tie_break]
    lags, windows = int_list(lag_periods), int_list(rolling_windows)
    y = F.col(f"`{target}`")

    def build(w):
        out = {f"{target}_lag_{k}": F.lag(y, k).over(w) for k in lags}
        for size in windows:
            before = w.rowsBetween(-size, -1)
            out[f"{target}_roll_mean_{size}"] = F.avg(y).over(before)
            out[f"{target}_roll_std_{size}"] = F.coalesce(F.stddev_samp(y).over(before), F.lit(0.0))
        return out

    rows = arrange(parsed, order, partition_by, max_task_rows)
    out = window_arranged(rows, build, max([*lags, *windows, 0]))
    if include_calendar_features:
        out = out.withColumns(calendar(F.col(f"`{date}`")))
    if fill == "backfill":
        names = [c for c in rows.over(out).plain().columns if c not in (*order, *partition_by)]
        nullable = [c for c in names if not c.startswith("cal_is") and "_roll_std_" not in c]
        out = fill_rest(fill_arranged(rows.over(out), nullable, "backward"), 0, names)
    return rows.over(out).plain()


def sorted_by_date(df: DataFrame, date: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Ascending, missing dates last."""
    return df.orderBy(*sort_keys([date, *tie_break]))


def infer_frequency(df: DataFrame, date: str, keys: Sequence[str] = (), max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """`(keys, seconds, frequency)`: the most common distance of neighbouring dates per series.

    D, W, M or H; D when nothing fits. Distances are counted before they are compared.
    """
    # Two rows of one date carry no distance: the distinct dates are what is ordered.
    at = df.select(*keys, F.col(f"`{date}`").alias("_at")).filter(F.col("_at").isNotNull()).distinct()
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)
    gaps = bounded_window(
        at, lambda w: {"_gap": (seconds(F.col("_at")) - seconds(F.lag("_at").over(w))).cast("long")}, 1, ["_at"], keys,
        max_task_rows=max_task_rows,
    )
    counts = gaps.filter(F.col("_gap").isNotNull()).groupBy(*keys, "_gap").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("m"), F.col("_gap").alias("gap")))["gap"].alias("seconds")
    common = counts.groupBy(*keys).agg(best) if keys else counts.agg(best)
    day = 86400
    return common.withColumn(
        "frequency",
        F.when(F.col("seconds") == 3600, "H").when(F.col("seconds") == 7 * day, "W")
        .when(F.col("seconds").between(28 * day, 31 * day), "M").otherwise("D"),
    )


def date_spine(df: DataFrame, date: str, horizon: int, frequency: str = "D", keys: Sequence[str] = ()) -> DataFrame:
    """The `horizon` dates that follow the last one of each series."""
    last = F.max(F.col(f"`{date}`").cast("timestamp_ntz")).alias("_last")
    ends = df.groupBy(*keys).agg(last) if keys else df.agg(last)
    return ends.select(*keys, F.explode(future_steps(F.col("_last"), horizon, frequency)).alias("ds"))


def date_range(df_keys: DataFrame, start: str, end: str, frequency: str = "D") -> DataFrame:
    """Every date from `start` to `end` for each row of `df_keys`."""
    dates = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), step_interval(frequency))
    return df_keys.select("*", F.explode(dates).alias("ds"))


def latest_rows(df: DataFrame, order: Sequence[str], keys: Sequence[str], n: int) -> DataFrame:
    """The last `n` rows per series, `_back` = 0 for the newest.

    The rank is filtered by a constant, so Spark keeps only `n` rows per series and
    map task before the shuffle; a hot series is not ranked whole.
    """
    desc = [F.col(f"`{o}`").desc() for o in order]
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*desc)
    ranked = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    return ranked.withColumn("_back", F.col("_rank") - 1).drop("_rank")
