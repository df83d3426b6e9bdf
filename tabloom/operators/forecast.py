"""Forecasts per series: trend with seasonality, and ARIMA.

Both are built from column expressions and the least squares of `leastsq`, so a
table with millions of short series and a table with one very long series run the
same way. Fitted coefficients are one row per series and can be stored and applied
again later.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import future_steps
from ..session import written_table
from .evaluate import forecast_metrics
from .leastsq import dot, fit_least_squares
from .ordered import MAX_TASK_ROWS, bounded_window
from .timeseries import latest_rows

MIN_POINTS = 5           # fixed value: fewest observations of a series
TREND_SHARE = 0.8        # part of the history in which the trend may bend
DAY = 86_400.0
# Period in days, number of sine/cosine pairs, history needed in days.
SEASONS = {"daily": (1.0, 4, 2.0), "weekly": (7.0, 3, 14.0), "yearly": (365.25, 10, 730.0)}
FORECAST_COLUMNS = ("ds", "yhat", "yhat_lower", "yhat_upper", "is_future")


def join_fit(rows: DataFrame, fit: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach the one fit row per series; null keys are a series too. Without keys the fit is a single row."""
    if keys:
        named = fit.withColumnsRenamed({k: f"_fit_{k}" for k in keys})
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_fit_{k}`")) for k in keys]
        return rows.join(named, same, how).drop(*[f"_fit_{k}" for k in keys])
    one = F.broadcast(fit.withColumn("_one", F.lit(1)))
    return rows.withColumn("_one", F.lit(1)).join(one, "_one", how).drop("_one")


def prepare_series(df: DataFrame, date: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """`(keys, ds, y)`: readable dates and numbers only."""
    y = F.col(f"`{target}`").try_cast("double")
    out = df.select(*keys, F.col(f"`{date}`").cast("timestamp_ntz").alias("ds"), F.when(~F.isnan(y), y).alias("y"))
    return out.filter(F.col("ds").isNotNull() & F.col("y").isNotNull())


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def _design(bends: int) -> tuple[Column, int]:
    """Array of regressors: constant, time, bends of the trend, waves of each season in use."""
    t = (_seconds(F.col("ds")) - F.col("_start")) / F.col("_span")
    days = _seconds(F.col("ds")) / DAY
    parts = [F.lit(1.0), t]
    parts += [F.greatest(t - TREND_SHARE * (i + 1) / (bends + 1), F.lit(0.0)) for i in range(bends)]
    for name, (period, pairs, _) in SEASONS.items():
        used = F.col(f"_{name}")
        for k in range(1, pairs + 1):
            angle = days * (2.0 * math.pi * k / period)
            parts += [F.when(used, F.sin(angle)).otherwise(0.0), F.when(used, F.cos(angle)).otherwise(0.0)]
    return F.array(*parts), len(parts)


def fit_additive(series: DataFrame, keys: Sequence[str] = (), seasonality_mode: str = "additive", bends: int = 10,
                 seasons: Sequence[str] = tuple(SEASONS)) -> DataFrame:
    """One row per series with at least five points: span, seasons in use, coefficients, residual spread.

    The allowed `seasons` switch on as their period is covered: daily and weekly need two periods
    and finer spacing, yearly two years. The multiplicative mode fits ln(y).
    """
    ends = [F.min("ds").alias("_first"), F.max("ds").alias("_last"), F.count(F.lit(1)).alias("_points"),
            F.count_distinct("ds").alias("_dates"), F.min("y").alias("_low"),
            F.max_by("y", "ds").alias("_last_y")]
    spans = (series.groupBy(*keys).agg(*ends) if keys else series.agg(*ends)).filter(F.col("_points") >= MIN_POINTS)
    length = (_seconds(F.col("_last")) - _seconds(F.col("_first"))) / DAY
    spacing = length / F.greatest(F.col("_dates") - 1, F.lit(1))
    spans = spans.withColumns({
        "_start": _seconds(F.col("_first")),
        "_span": F.greatest(length * DAY, F.lit(1.0)),
        "_daily": F.lit("daily" in seasons) & (length >= SEASONS["daily"][2]) & (spacing < 1.0 - 1e-9),
        "_weekly": F.lit("weekly" in seasons) & (length >= SEASONS["weekly"][2]) & (spacing < 7.0 - 1e-9),
        "_yearly": F.lit("yearly" in seasons) & (length >= SEASONS["yearly"][2]),
        "_log": (F.lit(seasonality_mode) == "multiplicative") & (F.col("_low") > 0),
    })
    x, width = _design(bends)
    y = F.when(F.col("_log"), F.ln("y")).otherwise(F.col("y"))
    rows = join_fit(series, spans, keys).select(*keys, x.alias("x"), y.alias("target"))
    penalties = [0.0, 0.0] + [1e-4] * bends + [1e-6] * (width - 2 - bends)
    solved = fit_least_squares(rows, "x", "target", width, keys, penalties)
    spread = F.sqrt(F.col("sse") / F.greatest(F.col("n") - 2, F.lit(1))).alias("_sigma")
    return join_fit(solved.select(*keys, "coef", spread), spans, keys).withColumn("_bends", F.lit(bends))


def predict_additive(dates: DataFrame, fit: DataFrame, keys: Sequence[str] = (), bends: int = 10, level: float = 0.95) -> DataFrame:
    """Add `yhat` with its band to any `(keys, ds)` rows; null for series without a fit."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    x, _ = _design(bends)
    rows = join_fit(dates, fit, keys, "left")
    back = lambda v: F.when(F.col("_log"), F.exp(v)).otherwise(v)
    rows = rows.withColumn("_m", dot(x, F.col("coef")))
    return rows.withColumns({
        "yhat": back(F.col("_m")),
        "yhat_lower": back(F.col("_m") - z * F.col("_sigma")),
        "yhat_upper": back(F.col("_m") + z * F.col("_sigma")),
        "is_future": F.coalesce((F.col("ds") > F.col("_last")).cast("int"), F.lit(0)),
    }).select(*dates.columns, "yhat", "yhat_lower", "yhat_upper", "is_future")


def forecast_table(rows: DataFrame, keys: Sequence[str] = (), date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The published form: date as text, numbers with 2 digits."""
    return rows.select(
        *keys, F.date_format("ds", date_format).alias("ds"),
        *[F.bround(c, 2).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")], "is_future",
    )


def spine_after(fit: DataFrame, horizon: int, frequency: str, keys: Sequence[str] = ()) -> DataFrame:
    return fit.select(*keys, F.explode(future_steps(F.col("_last"), horizon, frequency)).alias("ds"))


def additive_report(
    df: DataFrame, date: str, target: str, horizon_periods: int = 14, frequency: str = "D",
    seasonality_mode: str = "additive", keys: Sequence[str] = (), level: float = 0.95,
) -> tuple[DataFrame, DataFrame]:
    """`additive_forecast` and its `forecast_report`."""
    series = prepare_series(df, date, target, keys)
    fit = written_table(fit_additive(series, keys, seasonality_mode), "additive")
    dates = series.select(*keys, "ds").unionByName(spine_after(fit, horizon_periods, frequency, keys))
    out = forecast_table(predict_additive(dates, fit, keys, level=level), keys)
    errors = forecast_metrics(predict_additive(series, fit, keys), "y", "yhat", tuple(keys))
    return out, forecast_report(series, fit.select(*keys, F.lit(True).alias("_fitted")), errors, out, keys, "additive", horizon_periods)


def additive_forecast(
    df: DataFrame, date: str, target: str, horizon_periods: int = 14, frequency: str = "D",
    seasonality_mode: str = "additive", keys: Sequence[str] = (), level: float = 0.95,
) -> DataFrame:
    """History and future in one table, per series; a series of fewer than five points keeps its history, without a fit."""
    series = prepare_series(df, date, target, keys)
    fit = fit_additive(series, keys, seasonality_mode)
    dates = series.select(*keys, "ds").unionByName(spine_after(fit, horizon_periods, frequency, keys))
    return forecast_table(predict_additive(dates, fit, keys, level=level), keys)


def forecast_report(series: DataFrame, fit: DataFrame, errors: DataFrame, out: DataFrame, keys: Sequence[str],
                    algorithm: str, horizon: int) -> DataFrame:
    """One row per series: algorithm, points, horizon, errors on the history (`mae`, `rmse`, `mape`), what `fit`
    has beside `_fitted` (`aic`, `bic`), the trend of the forecast, and `status`: "fitted" or "too short"."""
    size = F.count(F.lit(1)).alias("historical_points")
    rows = series.groupBy(*keys).agg(size) if keys else series.agg(size)
    for part in (errors, fit, forecast_trend(out, keys=keys)):
        rows = join_fit(rows, part, keys, "left")
    fitted = F.coalesce("_fitted", F.lit(False))
    return rows.withColumns({
        "algorithm": F.lit(algorithm), "forecast_horizon": F.lit(horizon),
        # Without a fit nothing was forecast, so there is no error of 0 either.
        "mape": F.when(fitted, F.col("mape")), "status": F.when(fitted, "fitted").otherwise("too short"),
    }).drop("_fitted")


def _difference(series: DataFrame, d: int, keys: Sequence[str], max_task_rows: int) -> DataFrame:
    """Add `w`, the `d`-th difference of `y` in date order."""
    signs = [(-1) ** k * math.comb(d, k) for k in range(d + 1)]

    def build(window):
        out = F.lit(0.0)
        for k, s in enumerate(signs):
            out = out + s * (F.lag("y", k).over(window) if k else F.col("y"))
        return {"w": out}

    return bounded_window(series, build, d, ["ds"], keys, max_task_rows=max_task_rows)


def _lagged(df: DataFrame, column: str, lags: int, keys: Sequence[str], max_task_rows: int, name: str) -> DataFrame:
    return bounded_window(
        df, lambda w: {f"{name}{k}": F.lag(column, k).over(w) for k in range(1, lags + 1)}, lags, ["ds"], keys,
        max_task_rows=max_task_rows,
    )


def fit_arima(series: DataFrame, p: int = 1, d: int = 1, q: int = 1, keys: Sequence[str] = (),
              max_task_rows: int = MAX_TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Hannan-Rissanen ARIMA per series: (fit, history).

    A long autoregression gives the shocks, a second regression on lagged values and
    lagged shocks gives the coefficients (no constant when d > 0). `fit` has one row
    per series with `coef` = p lags then q shocks (then the constant), `sigma2`, `aic`,
    `bic`; `history` has the one-step fitted value `yhat` and shock `e` of every row, and
    whether it was `expected` from rows before it.
    Dates must be unique within a series.
    """
    counts = [F.count(F.lit(1)).alias("_points"), F.max("ds").alias("_last")]
    sizes = (series.groupBy(*keys).agg(*counts) if keys else series.agg(*counts)).filter(
        F.col("_points") >= p + d + q + 3
    )
    constant = [F.lit(1.0)] if d == 0 else []
    long_order = p + q + 2 if q else 0
    # A series with fewer complete rows than coefficients takes missing lags as 0 instead.
    lost = d + (max(long_order + q, p) if q else p)
    short = F.col("_points") - lost <= p + q + len(constant)
    sized = join_fit(series, sizes.select(*keys, short.alias("_short")), keys)
    work = _difference(sized, d, keys, max_task_rows)
    if q:
        work = _lagged(work, "w", max(long_order, p), keys, max_task_rows, "_w")
        whole = (F.col("_short") | F.col(f"_w{long_order}").isNotNull()) & F.col("w").isNotNull()
        padded = F.array(*[F.coalesce(F.col(f"_w{k}"), F.lit(0.0)) for k in range(1, long_order + 1)], F.lit(1.0))
        base = work.filter(whole).select(*keys, padded.alias("x"), "w")
        pre = fit_least_squares(base, "x", "w", long_order + 1, keys, [1e-9] * (long_order + 1))
        work = join_fit(work, pre.select(*keys, F.col("coef").alias("_pre")), keys)
        work = work.withColumn("_e0", F.when(whole, F.col("w") - dot(padded, F.col("_pre")))).drop("_pre")
        work = _lagged(work, "_e0", q, keys, max_task_rows, "_s")
    elif p:
        work = _lagged(work, "w", p, keys, max_task_rows, "_w")
    terms = [f"_w{k}" for k in range(1, p + 1)] + [f"_s{k}" for k in range(1, q + 1)]
    width = len(terms) + len(constant)
    if not width:
        # Pure differencing: the next difference is expected to be 0.
        stats = work.groupBy(*keys).agg(F.count("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("sse"))
        solved = stats.withColumn("coef", F.array().cast("array<double>"))
    else:
        complete = F.col("w").isNotNull()
        for t in terms:
            complete = complete & (F.col("_short") | F.col(t).isNotNull())
        x = F.array(*[F.coalesce(F.col(t), F.lit(0.0)) for t in terms], *constant)
        solved = fit_least_squares(
            work.filter(complete).select(*keys, x.alias("x"), "w"), "x", "w", width, keys, [1e-9] * width)
    n, k = F.col("n").cast("double"), float(width + 1)
    log_like = -0.5 * n * (F.ln(F.lit(2 * math.pi)) + F.ln(F.greatest(F.col("sigma2"), F.lit(1e-300))) + 1)
    solved = solved.withColumn("sigma2", F.col("sse") / F.greatest(n, F.lit(1.0))).withColumns({
        "aic": F.bround(2 * k - 2 * log_like, 2), "bic": F.bround(k * F.ln(n) - 2 * log_like, 2),
    })
    # One small row per series, read by the fit, the history and the future.
    solved = written_table(solved.select(*keys, "n", "coef", "sigma2", "aic", "bic"), "arima")
    fit = join_fit(solved, sizes, keys)
    padded = F.array(*[F.coalesce(F.col(t), F.lit(0.0)) for t in terms], *constant) if width else F.array().cast("array<double>")
    history = join_fit(work, solved.select(*keys, "coef"), keys)
    expected = dot(padded, F.col("coef")) if width else F.lit(0.0)
    # The first d rows have nothing to be predicted from: their fitted value is the value itself.
    history = history.withColumn("e", F.coalesce(F.col("w") - expected, F.lit(0.0)))
    return fit, history.select(*keys, "ds", "y", (F.col("y") - F.col("e")).alias("yhat"), "e", F.col("w").isNotNull().alias("expected"))


def predict_arima(fit: DataFrame, history: DataFrame, p: int, d: int, q: int, horizon: int, frequency: str = "D",
                  keys: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """`(keys, ds, yhat, yhat_lower, yhat_upper)` after the last date.

    Only the last few rows of a series are needed, so each series is a tiny group.
    """
    keys = list(keys)
    need = max(p + d, q, d + 1, 1)
    tail = join_fit(latest_rows(history, ["ds"], keys, need), fit, keys).select(
        *keys, "_back", "y", "e", "coef", "sigma2", "_last", future_steps(F.col("_last"), horizon, frequency).alias("_dates")
    )
    z = NormalDist().inv_cdf(0.5 + level / 2)
    signs = [(-1) ** k * math.comb(d, k) for k in range(d + 1)]
    schema = T.StructType([
        *[T.StructField(k, history.schema[k].dataType) for k in keys],
        T.StructField("ds", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in ("yhat", "yhat_lower", "yhat_upper")],
    ])

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_back")
        y = pdf["y"].to_list()[::-1]
        e = pdf["e"].to_list()[::-1]
        coef = np.asarray(pdf["coef"].iloc[0], dtype=float)
        ar, ma, const = coef[:p], coef[p:p + q], float(coef[p + q:].sum())
        w = [sum(s * y[i - k] for k, s in enumerate(signs)) for i in range(d, len(y))]
        # Autoregressive polynomial of the level series, for the weights of past shocks.
        poly = np.convolve(np.r_[1.0, -ar], np.asarray(signs, dtype=float))
        psi = [1.0]
        for j in range(1, horizon):
            value = ma[j - 1] if j <= q else 0.0
            psi.append(value - sum(poly[i] * psi[j - i] for i in range(1, min(j, len(poly) - 1) + 1)))
        means = []
        for _ in range(horizon):
            nxt = const + sum(ar[i] * w[-1 - i] for i in range(p) if i < len(w))
            nxt += sum(ma[i] * e[-1 - i] for i in range(q) if i < len(e))
            level_ = nxt - sum(signs[k] * y[-k] for k in range(1, d + 1))
            w.append(nxt)
            e.append(0.0)
            y.append(level_)
            means.append(level_)
        half = z * np.sqrt(pdf["sigma2"].iloc[0] * np.cumsum(np.square(psi)))
        means = np.asarray(means)
        out = pd.DataFrame({
            "ds": list(pdf["_dates"].iloc[0]), "yhat": means, "yhat_lower": means - half, "yhat_upper": means + half,
        })
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "ds", "yhat", "yhat_lower", "yhat_upper"]]

    return tail.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInPandas(project, schema)


def arima_report(
    df: DataFrame, date: str, target: str, p: int = 1, d: int = 1, q: int = 1, horizon_periods: int = 14,
    frequency: str = "D", keys: Sequence[str] = (), max_task_rows: int = MAX_TASK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """`arima_forecast` and its `forecast_report`; rows that nothing precedes are left out of the errors."""
    series = prepare_series(df, date, target, keys)
    fit, history = fit_arima(series, p, d, q, keys, max_task_rows)
    past = history.select(
        *keys, "ds", "yhat", F.col("yhat").alias("yhat_lower"), F.col("yhat").alias("yhat_upper"), F.lit(0).alias("is_future")
    )
    none = F.lit(None).cast("double")
    unfitted = join_fit(series, fit.select(*keys), keys, "left_anti").select(
        *keys, "ds", none.alias("yhat"), none.alias("yhat_lower"), none.alias("yhat_upper"), F.lit(0).alias("is_future"))
    future = predict_arima(fit, history, p, d, q, horizon_periods, frequency, keys).withColumn("is_future", F.lit(1))
    out = forecast_table(past.unionByName(unfitted).unionByName(future), keys)
    errors = forecast_metrics(history.filter("expected"), "y", "yhat", tuple(keys))
    found = fit.select(*keys, "aic", "bic", F.lit(True).alias("_fitted"))
    return out, forecast_report(series, found, errors, out, keys, f"arima({p},{d},{q})", horizon_periods)


def arima_forecast(
    df: DataFrame, date: str, target: str, p: int = 1, d: int = 1, q: int = 1, horizon_periods: int = 14,
    frequency: str = "D", keys: Sequence[str] = (), max_task_rows: int = MAX_TASK_ROWS,
) -> DataFrame:
    """History (with its one-step fit) and future in one table, per series; too short a series keeps its history, without a fit."""
    return arima_report(df, date, target, p, d, q, horizon_periods, frequency, keys, max_task_rows)[0]


def forecast_trend(rows: DataFrame, value: str = "yhat", date: str = "ds", keys: Sequence[str] = ()) -> DataFrame:
    """Start and end value, direction, and change in percent, per series; null for series without a fit."""
    exprs = [F.min_by(value, date).alias("start_value"), F.max_by(value, date).alias("projected_end_value")]
    ends = rows.groupBy(*keys).agg(*exprs) if keys else rows.agg(*exprs)
    start, end = F.col("start_value"), F.col("projected_end_value")
    return ends.withColumns({
        "trend": F.when(end >= start, "Upward").when(end < start, "Downward"),
        "projected_change_pct": F.bround((end - start) / (start + 1e-9) * 100.0, 2),
    })
