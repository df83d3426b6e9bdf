"""Choosing columns by name or by type."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names taken as a target when none is configured.
SCALER_TARGET_NAMES = ("target", "churn", "survived", "label", "class", "y")
ENCODER_TARGET_NAMES = ("target", "churn", "survived", "label", "class", "species", "y")
RECOMMENDER_TARGET_WORDS = ("target", "churn", "survived", "label", "price", "sales", "revenue")
DATE_COLUMN_WORDS = ("date", "time", "timestamp")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def _matches(dtype: T.DataType, auto: str) -> bool:
    if auto == "all":
        return True
    if auto == "numeric":
        return is_numeric(dtype)
    if auto == "string":
        return is_string(dtype)
    if auto == "non_numeric":
        return not is_numeric(dtype) and not isinstance(dtype, T.BooleanType)
    raise ValueError(f"unknown automatic column choice: {auto}")


def names_of(df: DataFrame, auto: str) -> list[str]:
    return [f.name for f in df.schema.fields if _matches(f.dataType, auto)]


def requested(df: DataFrame, columns: str | Iterable[str] | None) -> list[str]:
    """Names from a list or a comma string that exist in `df`, in the given order."""
    if columns is None:
        return []
    if isinstance(columns, str):
        if columns in df.columns:
            return [columns]
        columns = [part.strip() for part in columns.split(",")]
    known = set(df.columns)
    return [c for c in columns if c in known]


def resolve_columns(df: DataFrame, columns=None, auto: str = "all") -> list[str]:
    """The requested columns, or all columns of the wanted type when nothing usable is given."""
    return requested(df, columns) or names_of(df, auto)


def date_column(df: DataFrame, configured: str | None = None) -> str:
    if configured and configured in df.columns:
        return configured
    for field in df.schema.fields:
        named = any(word in field.name.lower() for word in DATE_COLUMN_WORDS)
        if named or is_datetime(field.dataType):
            return field.name
    return df.columns[0]


def last_numeric(df: DataFrame, configured: str | None = None, exclude: Iterable[str] = ()) -> str | None:
    """The configured column if present, else the last numeric column that is not excluded."""
    if configured and configured in df.columns:
        return configured
    skip = set(exclude)
    numeric = [c for c in names_of(df, "numeric") if c not in skip]
    return numeric[-1] if numeric else None


def int_list(value) -> list[int]:
    """`"1, 2, 7"` or `[1, 2, 7]` to integers; other parts are ignored."""
    parts = value.split(",") if isinstance(value, str) else value
    return [int(str(p).strip()) for p in parts if str(p).strip().isdigit()]
