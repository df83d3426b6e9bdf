import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import backtest, forecast, leastsq, timeseries

DAY0 = dt.datetime(2026, 1, 1)


def _daily(spark, values, name="Sales"):
    return spark.createDataFrame([(DAY0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)],
                                 f"Date timestamp_ntz, {name} double")


@pytest.mark.parametrize("limit", [10**6, 15])
def test_lag_features_equal_pandas(spark, limit):
    values = [100 + 10 * math.sin(i / 3) + i % 4 for i in range(60)]
    got = timeseries.lag_features(_daily(spark, values), max_task_rows=limit).toPandas().sort_values("Date")
    y = pd.Series(values)
    assert len(got) == 60
    for k in (1, 2, 3, 7, 14):
        want = y.shift(k).bfill()
        assert got[f"Sales_lag_{k}"].tolist() == pytest.approx(want.tolist())
    for w in (7, 14):
        past = y.shift(1).rolling(w, min_periods=1)
        assert got[f"Sales_roll_mean_{w}"].tolist() == pytest.approx(past.mean().bfill().tolist())
        assert got[f"Sales_roll_std_{w}"].tolist() == pytest.approx(past.std().fillna(0).tolist())
    assert got["cal_dayofweek"].tolist() == pd.date_range(DAY0, periods=60).dayofweek.tolist()


def test_text_dates_and_bad_dates(spark):
    df = spark.createDataFrame([("2026-01-02", 2.0), ("2026-01-01", 1.0), ("nonsense", 9.0)], "ds string, y double")
    got = timeseries.lag_features(df, lag_periods="1", rolling_windows="", fill="none")
    rows = {r.y: r for r in got.collect()}
    assert rows[2.0].y_lag_1 == 1.0 and rows[9.0].y_lag_1 == 2.0 and rows[9.0].ds is None


@pytest.mark.parametrize("frequency, second", [("D", "2026-02-02"), ("W", "2026-02-14"), ("H", "2026-01-31"), ("M", "2026-03-31")])
def test_date_spine(spark, frequency, second):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 31),)], "Date timestamp_ntz")
    got = [r.ds for r in timeseries.date_spine(df, "Date", 4, frequency).orderBy("ds").collect()]
    assert len(got) == 4 and str(got[1].date()) == second


def test_date_range_and_frequency(spark):
    keys = spark.createDataFrame([("a",)], "k string")
    assert timeseries.date_range(keys, "2026-01-01", "2026-01-10").count() == 10
    hours = spark.range(30).select(F.expr("timestampadd(HOUR, CAST(id AS INT), timestamp_ntz'2026-01-01')").alias("t"))
    assert timeseries.infer_frequency(hours, "t").first().frequency == "H"


def test_least_squares_per_key(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k, size in (("hot", 3000), ("cold", 40)):
        x = np.c_[np.ones(size), rng.normal(size=size)]
        y = x @ [3.0, -2.0] + rng.normal(scale=0.5, size=size)
        want[k] = np.linalg.lstsq(x, y, rcond=None)
        rows += [(k, [float(v) for v in a], float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "k string, x array<double>, y double").repartition(7)
    for r in leastsq.fit_least_squares(df, "x", "y", 2, ["k"]).collect():
        assert r.coef == pytest.approx(want[r.k][0].tolist(), abs=1e-8)
        assert r.sse == pytest.approx(float(want[r.k][1][0]), rel=1e-6)


def test_additive_forecast_shape_and_accuracy(spark):
    values = [50 + 100 * i / 44 + 3 * math.sin(2 * math.pi * i / 7) for i in range(45)]
    rows = forecast.additive_forecast(_daily(spark, values), "Date", "Sales", 7).orderBy("ds").collect()
    assert len(rows) == 52 and sum(r.is_future for r in rows) == 7
    assert rows[-1].ds == "2026-02-21"
    truth = 50 + 100 * 51 / 44 + 3 * math.sin(2 * math.pi * 51 / 7)
    assert abs(rows[-1].yhat - truth) < 5
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in rows)
    trend = forecast.forecast_trend(spark.createDataFrame(rows)).first()
    assert trend.trend == "Upward" and trend.projected_change_pct > 100


def test_multiplicative_stays_positive(spark):
    values = [math.exp(0.05 * i) for i in range(40)]
    rows = forecast.additive_forecast(_daily(spark, values), "Date", "Sales", 5, seasonality_mode="multiplicative").collect()
    last = max(rows, key=lambda r: r.ds)
    assert min(r.yhat_lower for r in rows) > 0 and last.yhat == pytest.approx(math.exp(0.05 * 44), rel=0.1)


@pytest.mark.parametrize("method", [forecast.additive_forecast, forecast.arima_forecast])
def test_short_series_keep_their_history(spark, method):
    df = _daily(spark, [1, 2, 3]).withColumn("k", F.lit(None).cast("string")).unionByName(
        _daily(spark, range(30)).withColumn("k", F.lit("long")))
    rows = method(df, "Date", "Sales", horizon_periods=3, keys=["k"]).collect()
    short = [r for r in rows if r.k is None]
    assert len(short) == 3 and all(r.yhat is None and r.is_future == 0 for r in short)
    assert len(rows) == 36 and all(r.yhat is not None for r in rows if r.k)
    trend = {r.k: r.trend for r in forecast.forecast_trend(spark.createDataFrame(rows), keys=["k"]).collect()}
    assert trend == {None: None, "long": "Upward"}
    assert [r.yhat for r in method(_daily(spark, [1, 2, 3]), "Date", "Sales").collect()] == [None] * 3


@pytest.mark.parametrize("limit", [10**6, 30])
def test_arima_finds_its_coefficient(spark, limit):
    rng = np.random.default_rng(2)
    w = [0.0]
    for _ in range(399):
        w.append(0.6 * w[-1] + rng.normal())
    y = 100 + np.cumsum(w)
    series = forecast.prepare_series(_daily(spark, y, "Demand"), "Date", "Demand")
    fit, history = forecast.fit_arima(series, 1, 1, 0, max_task_rows=limit)
    row = fit.first()
    assert row.coef[0] == pytest.approx(0.6, abs=0.08) and row.sigma2 == pytest.approx(1.0, abs=0.2)
    assert row.aic < row.bic and history.count() == 400
    ahead = forecast.predict_arima(fit, history, 1, 1, 0, 3).orderBy("ds").collect()
    step = (y[-1] - y[-2]) * row.coef[0]
    assert ahead[0].yhat == pytest.approx(y[-1] + step, abs=1e-6)
    assert ahead[1].yhat == pytest.approx(y[-1] + step + step * row.coef[0], abs=1e-6)
    half = [(r.yhat_upper - r.yhat) / 1.959963984540054 for r in ahead]
    assert half[0] == pytest.approx(math.sqrt(row.sigma2)) and half[1] == pytest.approx(
        math.sqrt(row.sigma2 * (1 + (1 + row.coef[0]) ** 2)))


def test_arima_forecast_shape(spark):
    values = [100 + 2 * i + (-1) ** i for i in range(50)]
    rows = forecast.arima_forecast(_daily(spark, values, "Demand"), "Date", "Demand", horizon_periods=10).collect()
    assert len(rows) == 60 and sum(r.is_future for r in rows) == 10
    assert all(r.yhat_lower == r.yhat == r.yhat_upper for r in rows if not r.is_future)
    flat = forecast.arima_forecast(_daily(spark, values, "Demand"), "Date", "Demand", 0, 1, 0, 4).filter("is_future = 1").collect()
    assert {r.yhat for r in flat} == {float(values[-1])}


def test_future_dates_follow_the_data(spark):
    df = _daily(spark, range(20))
    rows = forecast.additive_forecast(df, "Date", "Sales", 3).filter("is_future = 1").orderBy("ds").collect()
    assert [r.ds for r in rows] == ["2026-01-21", "2026-01-22", "2026-01-23"]


def test_null_key_is_a_series(spark):
    rows = [(k, dt.datetime(2026, 1, 1) + dt.timedelta(days=i), float(10 + i)) for k in ("a", None) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, d timestamp_ntz, y double")
    got = forecast.additive_forecast(df, "d", "y", 3, keys=["k"]).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"a": 23, None: 23}


def test_cut_offs_leave_later_dates_out(spark):
    days = [("a", i) for i in range(12)] + [("a", 11), (None, 0), (None, 1), (None, 2), (None, 3)]
    df = spark.createDataFrame([(k, DAY0 + dt.timedelta(days=i), float(i)) for k, i in days], "k string, ds timestamp_ntz, y double")
    cuts, tests = backtest.cut_offs(df, 2, 3, 4, ["k"])
    day = lambda t: (t - DAY0).days
    assert sorted((str(r.k), r.origin, day(r.cutoff)) for r in cuts.collect()) == [("None", 1, 1), ("a", 1, 9), ("a", 2, 5), ("a", 3, 1)]
    got = sorted((str(r.k), r.origin, r.step, day(r.ds)) for r in tests.collect())
    assert got == [("None", 1, 1, 2), ("None", 1, 2, 3), ("a", 1, 1, 10), ("a", 1, 2, 11), ("a", 1, 2, 11),
                   ("a", 2, 1, 6), ("a", 2, 2, 7), ("a", 3, 1, 2), ("a", 3, 2, 3)]
    assert backtest.cut_offs(df.filter("false"), 2, keys=["k"])[1].count() == 0
    with pytest.raises(ValueError):
        backtest.cut_offs(df, 0)


def test_backtest_equals_single_forecasts(spark):
    rng = np.random.default_rng(4)
    values = 100 + np.cumsum(rng.normal(size=60))
    df = _daily(spark, values)
    tested = backtest.backtest_arima(df, "Date", "Sales", 1, 1, 1, horizon=4, origins=2)
    rows = sorted(tested.collect(), key=lambda r: (r.origin, r.step))
    assert [(r.origin, r.step) for r in rows] == [(o, s) for o in (1, 2) for s in (1, 2, 3, 4)]
    for origin in (1, 2):
        series = forecast.prepare_series(_daily(spark, values[:60 - 4 * origin]), "Date", "Sales")
        fit, history = forecast.fit_arima(series, 1, 1, 1)
        ahead = forecast.predict_arima(fit, history, 1, 1, 1, 4).orderBy("ds").collect()
        mine = [r for r in rows if r.origin == origin]
        assert [r.yhat for r in mine] == pytest.approx([a.yhat for a in ahead])
        assert [r.y for r in mine] == pytest.approx(values[60 - 4 * origin:64 - 4 * origin].tolist())
    additive = backtest.backtest_additive(df, "Date", "Sales", 4, 2).filter("origin = 2").orderBy("step").collect()
    want = forecast.additive_forecast(_daily(spark, values[:52]), "Date", "Sales", 4).filter("is_future = 1").orderBy("ds").collect()
    assert [round(r.yhat, 2) for r in additive] == pytest.approx([w.yhat for w in want], abs=0.011)
    total = backtest.backtest_metrics(tested).first()
    assert (total.tested, total.unfitted) == (8, 0) and total.mae <= total.rmse and 0 <= total.coverage <= 1
    assert backtest.backtest_metrics(tested, ["step"]).count() == 4


def test_backtest_of_short_series(spark):
    df = _daily(spark, range(6))
    tested = backtest.backtest_additive(df, "Date", "Sales", 3, 2)
    assert [(r.origin, r.yhat) for r in tested.collect()] == [(1, None)] * 3
    row = backtest.backtest_metrics(tested).first()
    assert (row.tested, row.unfitted, row.mae) == (3, 3, None)


@pytest.mark.parametrize("order", [(1, 1, 1), (2, 0, 1), (1, 1, 0), (0, 2, 1)])
def test_shortest_arima_series_is_fitted(spark, order):
    values = [3.0, 5.0, 4.0, 7.0, 6.0, 9.0][:sum(order) + 3]
    out, report = forecast.arima_report(_daily(spark, values), "Date", "Sales", *order, 2)
    assert report.first().status == "fitted"
    assert all(r.yhat is not None and math.isfinite(r.yhat) for r in out.collect()) and out.count() == len(values) + 2


def test_report_per_series(spark):
    df = _daily(spark, [1, 2, 3]).withColumn("k", F.lit(None).cast("string")).unionByName(
        _daily(spark, [10 + i + (i % 3) for i in range(30)]).withColumn("k", F.lit("long")))
    for report in (forecast.additive_report(df, "Date", "Sales", 3, keys=["k"])[1], forecast.arima_report(df, "Date", "Sales", horizon_periods=3, keys=["k"])[1]):
        rows = {r.k: r for r in report.collect()}
        assert rows["long"].status == "fitted" and rows["long"].historical_points == 30 and rows["long"].mae < 2
        assert rows[None].status == "too short" and rows[None].mae is None and rows[None].mape is None and rows[None].historical_points == 3


def test_least_squares_sends_little(spark):
    """Short series are sent as their rows, long ones as one triangle per task, unused regressors not at all."""
    x = F.array(F.lit(1.0), F.col("id") / 7, F.lit(0.0), F.sin("id"), *[F.lit(0.0)] * 30)
    y = 3.0 + F.col("id") / 7 * 0.5 - 2 * F.sin("id")
    keys = F.when(F.col("id") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("id") % 40).alias("k")
    df = spark.range(9_000).repartition(5).select(keys, F.lit("a").alias("s"), x.alias("x"), y.alias("y"))
    rows = leastsq.fit_least_squares(df, "x", "y", 34, ["k", "s"]).collect()
    assert sum(r.n for r in rows) == 9_000 and {r.k for r in rows} == {None, *range(40)}
    for r in rows:
        assert [r.coef[i] for i in (0, 1, 3)] == pytest.approx([3.0, 0.5, -2.0], abs=1e-6) and sum(map(abs, r.coef)) < 5.6
    tall = leastsq._Triangle.of(np.eye(4)[np.arange(400) % 3], np.arange(400.0))
    assert len(tall.record()[2]) == 16 and tall.columns.tolist() == [0, 1, 2, 4]
    few = leastsq._Triangle.of(np.ones((2, 34)), np.ones(2))
    assert len(few.record()[2]) == 70
    assert leastsq.fit_least_squares(df.filter("false"), "x", "y", 34, ["k", "s"]).count() == 0
