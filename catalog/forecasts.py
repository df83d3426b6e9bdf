"""Forecasts in closed form: a straight trend and ARIMA(1,1,0), their reports and rolling-origin backtests."""

from pyspark.sql import functions as F

from tabloom.operators import backtest
from tabloom.plans import pipeline

from .base import DAILY_EVENTS, daily_events, query

HORIZON, ORIGINS, STRIDE = 5, 3, 4

# Rows of every cut-off: `ahead` is 0 or less in the training part, 1 to the horizon in the tested part.
_PARTS = f"""s AS (SELECT event_type, day AS ds, total AS y FROM {DAILY_EVENTS}),
    b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ds DESC) - 1 AS back FROM s),
    o AS (SELECT CAST(unnest(range(1, {ORIGINS + 1})) AS INTEGER) AS origin),
    p AS (SELECT event_type, origin, ds, y, CAST({HORIZON} + (origin - 1) * {STRIDE} - back AS INTEGER) AS ahead FROM b, o),
    c AS (SELECT event_type, origin, max(ds) AS cutoff, min(ds) AS first FROM p WHERE ahead <= 0 GROUP BY 1, 2)"""
_Z = "1.959963984540054::DOUBLE"


@query("backtest_trend", f"""WITH {_PARTS},
    x AS (SELECT p.*, cutoff, (epoch(ds) - epoch(first)) / (epoch(cutoff) - epoch(first)) AS t FROM p JOIN c USING (event_type, origin)),
    f AS (SELECT event_type, origin, regr_slope(y, t) AS a, regr_intercept(y, t) AS i,
      sqrt(regr_syy(y, t) * (1 - regr_r2(y, t)) / (count(*) - 2)) AS sigma FROM x WHERE ahead <= 0 GROUP BY 1, 2)
    SELECT event_type, origin, cutoff, ahead AS step, ds, y, round(i + a * t, 4) AS yhat,
      round(i + a * t - {_Z} * sigma, 4) AS yhat_lower, round(i + a * t + {_Z} * sigma, 4) AS yhat_upper
    FROM x JOIN f USING (event_type, origin) WHERE ahead BETWEEN 1 AND {HORIZON}""")
def backtest_trend(spark, sf):
    out = backtest.backtest_additive(daily_events(spark, sf), "day", "total", HORIZON, ORIGINS, STRIDE, ["event_type"], bends=0, seasons=())
    return out.withColumns({c: F.round(c, 4) for c in ("yhat", "yhat_lower", "yhat_upper")})


# phi is the quotient of the sums of neighbouring differences; the variance grows with the squared weights of past shocks.
def _ar(part: str) -> str:
    return f"""w AS (SELECT *, y - lag(y) OVER v AS w FROM tr WINDOW v AS (PARTITION BY {part} ORDER BY ds)),
    l AS (SELECT *, lag(w) OVER (PARTITION BY {part} ORDER BY ds) AS w1 FROM w),
    q AS (SELECT {part}, count(w1) AS n, sum(w * w1) AS b, sum(w1 * w1) AS g, sum(CASE WHEN w1 IS NOT NULL THEN w * w END) AS yy FROM l GROUP BY ALL),
    f AS (SELECT {part}, n, b / (g + 1e-9 * n) AS phi, (yy - 2 * b * b / (g + 1e-9 * n) + g * (b / (g + 1e-9 * n)) ** 2) / n AS sigma2 FROM q),
    e AS (SELECT {part}, arg_max(y, ds) AS last_y, arg_max(w, ds) AS last_w, arg_min(y, ds) AS first_y, count(*) AS points FROM l GROUP BY ALL)"""


@query("backtest_arima", f"""WITH {_PARTS}, tr AS (SELECT * FROM p WHERE ahead <= 0), {_ar('event_type, origin')},
    t AS (SELECT p.event_type, p.origin, ahead, y, last_y + last_w * phi * (1 - phi ** ahead) / (1 - phi) AS yhat,
        {_Z} * sqrt(sigma2 * list_sum([((1 - phi ** (j + 1)) / (1 - phi)) ** 2 FOR j IN range(0, ahead)])) AS half
      FROM p JOIN f USING (event_type, origin) JOIN e USING (event_type, origin) WHERE ahead BETWEEN 1 AND {HORIZON})
    SELECT event_type, count(*) AS tested, CAST(0 AS BIGINT) AS unfitted, round_even(avg(abs(y - yhat)), 4) AS mae,
      round_even(sqrt(avg((y - yhat) ** 2)), 4) AS rmse, round_even(avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) * 100, 2) AS mape,
      round_even(avg(yhat - y), 4) AS bias, round_even(avg(CAST(abs(y - yhat) <= half AS INTEGER)), 4) AS coverage FROM t GROUP BY 1""")
def backtest_arima(spark, sf):
    tested = backtest.backtest_arima(daily_events(spark, sf), "day", "total", 1, 1, 0, HORIZON, ORIGINS, STRIDE, ["event_type"])
    return backtest.backtest_metrics(tested, ["event_type"])


_LL = "(-0.5 * n * (ln(2 * pi()) + ln(sigma2) + 1))"
_END = "round_even(last_y + last_w * phi * (1 - phi ** 7) / (1 - phi), 2)"


@query("forecast_evaluated", f"""WITH tr AS (SELECT event_type, day AS ds, total AS y FROM {DAILY_EVENTS}), {_ar('event_type')},
    r AS (SELECT event_type, w - phi * coalesce(w1, 0) AS err, y FROM l JOIN f USING (event_type) WHERE w IS NOT NULL),
    m AS (SELECT event_type, round_even(avg(abs(err)), 4) AS mae, round_even(sqrt(avg(err * err)), 4) AS rmse,
      round_even(avg(CASE WHEN y <> 0 THEN abs(err) / abs(y) END) * 100, 2) AS mape FROM r GROUP BY 1)
    SELECT event_type, points AS historical_points, mae, rmse, mape, round_even(4 - 2 * {_LL}, 2) AS aic, round_even(2 * ln(n) - 2 * {_LL}, 2) AS bic,
      round_even(first_y, 2) AS start_value, {_END} AS projected_end_value, CASE WHEN {_END} >= first_y THEN 'Upward' ELSE 'Downward' END AS trend,
      round_even(({_END} - first_y) / (first_y + 1e-9) * 100, 2) AS projected_change_pct, 'arima(1,1,0)' AS algorithm,
      CAST(7 AS INTEGER) AS forecast_horizon, 'fitted' AS status
    FROM f JOIN e USING (event_type) JOIN m USING (event_type)""")
def forecast_evaluated(spark, sf):
    nodes = [("load", "csv_loader", {}),
             ("forecast", "arima_forecaster", {"p": 1, "d": 1, "q": 0, "horizon_periods": 7, "date_column": "day", "target_column": "total",
                                               "partition_by": ["event_type"]}),
             ("judge", "model_evaluator", {})]
    spec = {"nodes": [{"id": i, "recipe_id": r, "config": c} for i, r, c in nodes],
            "edges": [{"source": "load", "target": "forecast"}, {"source": "forecast", "target": "judge"}]}
    return pipeline.run_pipeline(spec, daily_events(spark, sf))["judge"]["metrics"]
