"""Missing values: learned or constant fills, row removal, and fills in row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import is_fractional, is_numeric, is_string, resolve_columns
from ..functions.numeric import nan_to_null
from .ordered import MAX_TASK_ROWS, fill_ordered
from .quantiles import exact_quantiles, modes

STRATEGIES = ("mean", "median", "mode", "constant", "drop_rows", "ffill", "bfill")
MISSING_TEXT = "Missing"


def fit_fills(
    df: DataFrame, strategy: str = "median", columns=None, fill_value: object = 0, approximate: bool = False
) -> dict[str, object]:
    """The replacement for each column; replaying it on new rows gives the same fills.

    All means come from one aggregate, all medians from one quantile search and all
    modes from one count of values.
    """
    names = resolve_columns(df, columns)
    if strategy == "constant":
        return {n: fill_value for n in names}
    if strategy not in ("mean", "median", "mode"):
        raise ValueError(f"{strategy} learns no fill values")
    clean = nan_to_null(df, names)
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [n for n in names if is_numeric(types[n])] if strategy != "mode" else []
    other = [n for n in names if n not in numeric]
    fills: dict[str, object] = {}
    if numeric and strategy == "mean":
        row = clean.agg(*[F.avg(F.col(f"`{n}`").cast("double")).alias(f"m{i}") for i, n in enumerate(numeric)]).first()
        fills.update({n: row[f"m{i}"] for i, n in enumerate(numeric)})
    elif numeric and approximate:
        row = clean.agg(*[F.percentile_approx(f"`{n}`", 0.5).alias(f"m{i}") for i, n in enumerate(numeric)]).first()
        fills.update({n: row[f"m{i}"] for i, n in enumerate(numeric)})
    elif numeric:
        fills.update({n: q[0] for n, q in exact_quantiles(clean, {n: [0.5] for n in numeric}).items()})
    fills.update(modes(clean, other))
    for n in names:
        if fills[n] is None:
            fills[n] = 0 if is_numeric(types[n]) else MISSING_TEXT
    return {n: fills[n] for n in names}


def apply_fills(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Replace nulls (and NaN) by the given values; columns that `df` lacks are skipped.

    A whole-number column that gets a fractional fill becomes double, so that no
    learned mean or median is cut off.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    clean = nan_to_null(df, [n for n in fills if n in types])
    out = {}
    for n, value in fills.items():
        if n not in types:
            continue
        dtype = types[n]
        fractional = isinstance(value, float) and not value.is_integer()
        if is_numeric(dtype) and not is_fractional(dtype) and fractional:
            dtype = T.DoubleType()
        # A value that does not fit the column's type fills nothing.
        literal = F.lit(value if is_numeric(dtype) else str(value)).try_cast(dtype)
        out[n] = F.coalesce(F.col(f"`{n}`").cast(dtype), literal)
    return clean.withColumns(out)


def drop_incomplete(df: DataFrame, columns=None) -> DataFrame:
    """Keep only rows without a null or NaN in the chosen columns."""
    return df.dropna(how="any", subset=resolve_columns(df, columns))


def impute(
    df: DataFrame,
    strategy: str = "median",
    columns=None,
    fill_value: object = 0,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    approximate: bool = False,
    max_task_rows: int = MAX_TASK_ROWS,
) -> DataFrame:
    """One call for every strategy; `ffill` and `bfill` need `order_by`."""
    if strategy == "drop_rows":
        return drop_incomplete(df, columns)
    if strategy in ("ffill", "bfill"):
        if not order_by:
            raise ValueError(f"{strategy} needs order_by: a Spark table has no row order")
        names = [n for n in resolve_columns(df, columns) if n not in (*order_by, *partition_by)]
        direction = "forward" if strategy == "ffill" else "backward"
        clean = nan_to_null(df, names)
        return fill_ordered(clean, names, order_by, partition_by, direction, max_task_rows=max_task_rows)
    return apply_fills(df, fit_fills(df, strategy, columns, fill_value, approximate))


def fill_rest(df: DataFrame, number: float = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """Numbers left null become `number`; text left null becomes its text."""
    names = columns if columns is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for n in names:
        if is_numeric(types[n]):
            out[n] = F.coalesce(F.col(f"`{n}`"), F.lit(number).cast(types[n]))
        elif is_string(types[n]):
            out[n] = F.coalesce(F.col(f"`{n}`"), F.lit(str(number)))
    return df.withColumns(out)
