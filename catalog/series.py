"""Lag, rolling and calendar features; date spines and spacing."""

from pyspark.sql import functions as F

from tabloom.operators import timeseries

from .base import DAILY_EVENTS, DAILY_REVENUE, daily_events, daily_revenue, query, table


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_W = "(ORDER BY day)"


@query("lag_features", "SELECT day, revenue, " + ", ".join(
    f"lag(revenue, {k}) OVER {_W} AS revenue_lag_{k}" for k in (1, 2, 3, 7, 14)) + f" FROM {DAILY_REVENUE}")
def lag_features(spark, sf):
    return timeseries.lag_features(daily_revenue(spark, sf), "day", "revenue", rolling_windows="",
                                   include_calendar_features=False, fill="none")


def _rolling(value, w, partition=""):
    frame = f"OVER ({partition} ORDER BY day ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return (f"avg({value}) {frame} AS {value}_roll_mean_{w}, "
            f"coalesce(stddev_samp({value}) {frame}, 0) AS {value}_roll_std_{w}")


@query("rolling_features", f"""SELECT event_type, day, n, total, round(total_roll_mean_3, 6) AS total_roll_mean_3,
    round(total_roll_std_3, 4) AS total_roll_std_3, round(total_roll_mean_7, 6) AS total_roll_mean_7,
    round(total_roll_std_7, 4) AS total_roll_std_7 FROM (SELECT *,
    {_rolling('total', 3, 'PARTITION BY event_type')}, {_rolling('total', 7, 'PARTITION BY event_type')} FROM {DAILY_EVENTS})""")
def rolling_features(spark, sf):
    out = timeseries.lag_features(daily_events(spark, sf), "day", "total", lag_periods=[], rolling_windows="3, 7",
                                  include_calendar_features=False, partition_by=["event_type"], fill="none")
    out = _round(out, "total_roll_mean_3", "total_roll_mean_7")
    return out.withColumns({n: F.round(n, 4) for n in ("total_roll_std_3", "total_roll_std_7")})


@query("rolling_features_blocks", f"""SELECT o_orderkey, o_orderdate, o_totalprice, o_totalprice_lag_5,
    round(m, 6) AS o_totalprice_roll_mean_4, round(s, 4) AS o_totalprice_roll_std_4 FROM (SELECT o_orderkey, o_orderdate,
    o_totalprice, lag(o_totalprice, 5) OVER (ORDER BY o_orderdate, o_orderkey) AS o_totalprice_lag_5,
    avg(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m,
    coalesce(stddev_samp(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS s
    FROM orders)""")
def rolling_features_blocks(spark, sf):
    # One series over the whole table, cut into blocks even at test size.
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    out = timeseries.lag_features(o, "o_orderdate", "o_totalprice", "5", "4", False, tie_break=["o_orderkey"], fill="none",
                                  max_task_rows=2000)
    return _round(out, "o_totalprice_roll_mean_4").withColumn("o_totalprice_roll_std_4", F.round("o_totalprice_roll_std_4", 4))


@query("calendar_features", """SELECT event_id, ts, value, CAST(isodow(ts) - 1 AS INTEGER) AS cal_dayofweek,
    CAST(month(ts) AS INTEGER) AS cal_month, CAST(day(ts) AS INTEGER) AS cal_day,
    CAST(isodow(ts) >= 6 AS INTEGER) AS cal_is_weekend FROM events""")
def calendar_features(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    return timeseries.lag_features(e, "ts", "value", [], [], True, tie_break=["event_id"], fill="none")


_BACK = "OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("lag_backfilled", f"""WITH l AS (SELECT *, lag(revenue, 1) OVER {_W} AS l1, lag(revenue, 14) OVER {_W} AS l14,
      {_rolling('revenue', 7)} FROM {DAILY_REVENUE})
    SELECT day, revenue, coalesce(first_value(l1 IGNORE NULLS) {_BACK}, 0) AS revenue_lag_1,
      coalesce(first_value(l14 IGNORE NULLS) {_BACK}, 0) AS revenue_lag_14,
      round(coalesce(first_value(revenue_roll_mean_7 IGNORE NULLS) {_BACK}, 0), 4) AS revenue_roll_mean_7,
      round(revenue_roll_std_7, 2) AS revenue_roll_std_7,
      CAST(isodow(day) - 1 AS INTEGER) AS cal_dayofweek, CAST(month(day) AS INTEGER) AS cal_month,
      CAST(day(day) AS INTEGER) AS cal_day, CAST(isodow(day) >= 6 AS INTEGER) AS cal_is_weekend FROM l""")
def lag_backfilled(spark, sf):
    out = timeseries.lag_features(daily_revenue(spark, sf), "day", "revenue", "1, 14", "7")
    return out.withColumn("revenue_roll_mean_7", F.round("revenue_roll_mean_7", 4)).withColumn(
        "revenue_roll_std_7", F.round("revenue_roll_std_7", 2))


@query("date_spine", """SELECT event_type, unnest(generate_series(date_trunc('day', max(ts))::TIMESTAMP + INTERVAL 1 DAY,
    date_trunc('day', max(ts))::TIMESTAMP + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS ds FROM events GROUP BY event_type""")
def date_spine(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.date_trunc("day", "ts").alias("day"))
    return timeseries.date_spine(e, "day", 30, "D", ["event_type"])


@query("freq_infer", f"""WITH g AS (SELECT event_type, CAST(epoch(day) - epoch(lag(day) OVER (PARTITION BY event_type ORDER BY day)) AS BIGINT) AS gap
      FROM (SELECT DISTINCT event_type, day FROM {DAILY_EVENTS})),
    c AS (SELECT event_type, gap, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, gap) AS rn FROM g
      WHERE gap IS NOT NULL GROUP BY 1, 2)
    SELECT event_type, gap AS seconds, CASE WHEN gap = 3600 THEN 'H' WHEN gap = 604800 THEN 'W'
      WHEN gap BETWEEN 28 * 86400 AND 31 * 86400 THEN 'M' ELSE 'D' END AS frequency FROM c WHERE rn = 1""")
def freq_infer(spark, sf):
    return timeseries.infer_frequency(daily_events(spark, sf), "day", ["event_type"])
