"""Expressions on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One step of each forecast frequency.
STEP_INTERVALS = {
    "D": "INTERVAL 1 DAY",
    "W": "INTERVAL 7 DAY",
    "M": "INTERVAL 1 MONTH",
    "H": "INTERVAL 1 HOUR",
}


def as_timestamp(c: Column, dtype: T.DataType) -> Column:
    """Dates and timestamps as they are, text parsed with null on failure, other types null."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return c
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def calendar(c: Column) -> dict[str, Column]:
    """Weekday (Monday = 0), month, day of month and weekend flag."""
    weekday = F.weekday(c)
    return {
        "cal_dayofweek": weekday,
        "cal_month": F.month(c),
        "cal_day": F.dayofmonth(c),
        "cal_is_weekend": F.when(weekday.isNull(), 0).otherwise((weekday >= 5).cast("int")),
    }


def step_interval(frequency: str) -> Column:
    return F.expr(STEP_INTERVALS[frequency.strip()[0].upper()])


def future_steps(last: Column, horizon: int, frequency: str) -> Column:
    """Array of the `horizon` dates that follow `last`.

    Months are added to `last` itself, so a month end stays one where it can.
    """
    code = frequency.strip()[0].upper()
    if code == "M":
        return F.transform(
            F.sequence(F.lit(1), F.lit(horizon)),
            lambda i: F.make_ym_interval(F.lit(0), i) + last,
        )
    step = F.expr(STEP_INTERVALS[code])
    return F.slice(F.sequence(last, last + step * F.lit(horizon), step), 2, horizon)
