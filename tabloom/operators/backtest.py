"""Rolling-origin evaluation: several cut-offs of every series are fitted and judged in one job.

A cut-off is one more key of the series, so the fits of all series and all cut-offs are one
pass of the same least squares. Only the last dates of a series decide on its cut-offs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import forecast
from .evaluate import error_columns
from .forecast import join_fit
from .ordered import MAX_TASK_ROWS
from .timeseries import latest_rows


def cut_offs(series: DataFrame, horizon: int, origins: int = 3, step: int | None = None, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(cuts, tests) of a prepared series.

    `cuts` is `(keys, origin, cutoff)`: training ends with the date `cutoff`, and the next `horizon`
    dates are tested. Origin 1 leaves `horizon` dates, each further one `step` (default: `horizon`)
    dates more. `tests` is `(keys, origin, cutoff, step, ds, y)`, step 1 being the first date after
    the cut-off. A series with too few dates for an origin has no row for it.
    """
    if horizon < 1 or origins < 1 or (step is not None and step < 1):
        raise ValueError("horizon, origins and step must be at least 1")
    stride = step or horizon
    dates = latest_rows(series.select(*keys, "ds").distinct(), ["ds"], keys, horizon + (origins - 1) * stride + 1)
    ahead = F.lit(horizon) + (F.col("origin") - 1) * stride - F.col("_back")
    placed = dates.withColumn("origin", F.explode(F.sequence(F.lit(1), F.lit(origins)))).withColumn("step", ahead)
    cuts = placed.filter("step = 0").select(*keys, "origin", F.col("ds").alias("cutoff"))
    tested = placed.filter(F.col("step").between(1, horizon)).select(*keys, "origin", "step", "ds")
    tested = join_fit(tested, cuts, [*keys, "origin"])
    return cuts, join_fit(series, tested, [*keys, "ds"]).select(*keys, "origin", "cutoff", "step", "ds", "y")


def _training(series: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_fit(series, cuts, keys).filter(F.col("ds") <= F.col("cutoff")).select(*keys, "origin", "ds", "y")


def backtest_additive(
    df: DataFrame, date: str, target: str, horizon: int = 14, origins: int = 3, step: int | None = None, keys: Sequence[str] = (),
    seasonality_mode: str = "additive", bends: int = 10, seasons: Sequence[str] = tuple(forecast.SEASONS), level: float = 0.95,
) -> DataFrame:
    """`(keys, origin, cutoff, step, ds, y, yhat, yhat_lower, yhat_upper)` for the tested dates of every cut-off.

    Parts too short for a fit come back with null forecasts.
    """
    series = forecast.prepare_series(df, date, target, keys)
    cuts, tests = cut_offs(series, horizon, origins, step, keys)
    parts = [*keys, "origin"]
    fit = forecast.fit_additive(_training(series, cuts, keys), parts, seasonality_mode, bends, seasons)
    return forecast.predict_additive(tests, fit, parts, bends, level).drop("is_future")


def backtest_arima(
    df: DataFrame, date: str, target: str, p: int = 1, d: int = 1, q: int = 1, horizon: int = 14, origins: int = 3,
    step: int | None = None, keys: Sequence[str] = (), level: float = 0.95, max_task_rows: int = MAX_TASK_ROWS,
) -> DataFrame:
    """As `backtest_additive`; the k-th forecast is held against the k-th date after the cut-off, also where dates are missing."""
    series = forecast.prepare_series(df, date, target, keys)
    cuts, tests = cut_offs(series, horizon, origins, step, keys)
    parts = [*keys, "origin"]
    fit, history = forecast.fit_arima(_training(series, cuts, keys), p, d, q, parts, max_task_rows)
    ahead = forecast.predict_arima(fit, history, p, d, q, horizon, keys=parts, level=level)
    numbered = ahead.withColumn("step", F.row_number().over(Window.partitionBy(*parts).orderBy("ds"))).drop("ds")
    return join_fit(tests, numbered, [*parts, "step"], "left").select(*tests.columns, "yhat", "yhat_lower", "yhat_upper")


def backtest_metrics(tested: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors of a backtest, in all or per columns `by` (the keys, `origin`, `step`).

    `tested` and `unfitted` rows, `mae`, `rmse`, `mape` in percent, `bias` (mean forecast minus actual) and
    `coverage`, the share of actual values inside the band.
    """
    y, p = F.col("y"), F.col("yhat")
    exprs = [F.count(F.lit(1)).alias("tested"), F.count_if(p.isNull()).alias("unfitted"), *error_columns("y", "yhat"),
             F.bround(F.avg(p - y), 4).alias("bias"),
             F.bround(F.avg(y.between(F.col("yhat_lower"), F.col("yhat_upper")).cast("int")), 4).alias("coverage")]
    return tested.groupBy(*by).agg(*exprs) if by else tested.agg(*exprs)
