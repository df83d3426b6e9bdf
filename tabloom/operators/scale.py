"""Feature scaling with learned shift and factor; transform is plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import SCALER_TARGET_NAMES, names_of, requested
from ..functions.numeric import nan_to_null
from .quantiles import exact_quantiles

METHODS = ("standard", "minmax", "robust")


def _filled(df: DataFrame, names: list[str]) -> DataFrame:
    clean = nan_to_null(df.select(*[F.col(f"`{n}`") for n in names]), names)
    return clean.select(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)).alias(n) for n in names])


def scalable_columns(df: DataFrame, exclude_target: bool = True) -> list[str]:
    """Numeric columns, without likely targets: by name, or with at most two values.

    "At most two values" is decided without counting distinct values: every known
    value is the minimum or the maximum.
    """
    numeric = names_of(df, "numeric")
    if not exclude_target or not numeric:
        return numeric
    clean = nan_to_null(df, numeric)
    ends = clean.agg(*[e for i, n in enumerate(numeric)
                       for e in (F.min(f"`{n}`").alias(f"a{i}"), F.max(f"`{n}`").alias(f"z{i}"))]).first()
    between = clean.agg(*[
        F.coalesce(F.bool_or((F.col(f"`{n}`") > F.lit(ends[f"a{i}"])) & (F.col(f"`{n}`") < F.lit(ends[f"z{i}"]))),
                   F.lit(False)).alias(f"b{i}")
        for i, n in enumerate(numeric)
    ]).first()
    kept = [n for i, n in enumerate(numeric) if between[f"b{i}"] and n.lower() not in SCALER_TARGET_NAMES]
    return kept or numeric


def fit_scaler(df: DataFrame, method: str = "standard", columns=None, exclude_target: bool = True) -> dict:
    """`{"method": …, "columns": {name: {"shift": a, "factor": b}}}` for `(x - a) / b`; null is 0."""
    if method not in METHODS:
        raise ValueError(f"unknown scaling method: {method}")
    names = requested(df, columns) or scalable_columns(df, exclude_target)
    if not names:
        return {"method": method, "columns": {}}
    filled = _filled(df, names)
    learned = {}
    if method == "robust":
        for n, (q1, mid, q3) in exact_quantiles(filled, {n: [0.25, 0.5, 0.75] for n in names}).items():
            learned[n] = (mid, None if q1 is None else q3 - q1)
    else:
        first, second = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
        row = filled.agg(*[e for i, n in enumerate(names)
                           for e in (first(f"`{n}`").alias(f"a{i}"), second(f"`{n}`").alias(f"b{i}"))]).first()
        for i, n in enumerate(names):
            a, b = row[f"a{i}"], row[f"b{i}"]
            learned[n] = (a, b if method == "standard" or b is None else b - a)
    return {
        "method": method,
        "columns": {n: {"shift": a or 0.0, "factor": b or 1.0} for n, (a, b) in learned.items()},
    }


def apply_scaler(df: DataFrame, fitted: dict) -> DataFrame:
    present = {n: p for n, p in fitted["columns"].items() if n in df.columns}
    clean = nan_to_null(df, list(present))
    return clean.withColumns({
        n: (F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) - F.lit(p["shift"])) / F.lit(p["factor"])
        for n, p in present.items()
    })


def scale(df: DataFrame, method: str = "standard", columns=None, exclude_target: bool = True) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, method, columns, exclude_target))
