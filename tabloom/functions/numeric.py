"""Expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import is_fractional


def finite_or_null(c: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clean_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every floating-point column."""
    return df.select(*[
        finite_or_null(F.col(f"`{f.name}`")).alias(f.name) if is_fractional(f.dataType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def nan_to_null(df: DataFrame, names: list[str]) -> DataFrame:
    """NaN to null (infinities stay) in the named floating-point columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        n: F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")) for n in names if is_fractional(types[n])
    })


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.bround(part.cast("double") / whole.cast("double") * 100.0, digits)


def sigmoid_risk(decision: Column) -> Column:
    """Anomaly score of new rows from the forest's decision value (negative = outlier)."""
    return F.bround(F.lit(1.0) / (F.lit(1.0) + F.exp(decision * 4.0)), 4)


def risk_band(score: Column) -> Column:
    return (
        F.when(score > 0.8, "CRITICAL").when(score > 0.6, "HIGH").when(score > 0.4, "MEDIUM").otherwise("LOW")
    )


def verdict(flag: Column) -> Column:
    return F.when(flag == 1, "ANOMALOUS_OUTLIER").otherwise("NORMAL_RECORD")
