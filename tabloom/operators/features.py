"""Turning raw columns into model features, fitted on the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import is_datetime, is_numeric, is_string, names_of
from ..functions.dates import as_timestamp
from ..functions.numeric import nan_to_null
from .encode import apply_encoder, fit_encoder
from .impute import apply_fills, fit_fills

# Limits of one-hot columns in trainers, share of readable dates.
ONE_HOT_LEVELS, ONE_HOT_SHARE = 30, 0.3
DATE_SHARE = 0.5
MISSING_CATEGORY = "missing"


def align_columns(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), default: float = 0.0) -> DataFrame:
    """Exactly the wanted columns in order: missing ones are `default`, others dropped."""
    have = set(df.columns)
    return df.select(
        *[F.col(f"`{c}`") for c in keep if c in have],
        *[F.col(f"`{c}`") if c in have else F.lit(default).alias(c) for c in features],
    )


def _date_like(df: DataFrame, names: list[str]) -> list[str]:
    """Columns in which more than half of the rows can be read as a date; one aggregate."""
    if not names:
        return []
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count(as_timestamp(F.col(f"`{n}`"), df.schema[n].dataType)).alias(f"c{i}") for i, n in enumerate(names)
    ]).first()
    return [n for i, n in enumerate(names) if seen[f"c{i}"] > DATE_SHARE * seen["rows"]]


def fit_features(train: DataFrame, exclude: Sequence[str] = ()) -> dict:
    """Dates become year, month, day; few levels become 0/1 columns; other text becomes codes.

    Levels come from the training rows only; a level never seen there is -1 (codes)
    or all zeros (0/1 columns).
    """
    source = train.select(*[F.col(f"`{c}`") for c in train.columns if c not in exclude])
    dated = [f.name for f in source.schema.fields if is_datetime(f.dataType)]
    texts = names_of(source, "string")
    dated += _date_like(source, texts)
    texts = [n for n in texts if n not in dated]
    encoder: dict = {"method": "features", "steps": {}}
    if texts:
        few = source.agg(
            F.count(F.lit(1)).alias("rows"), *[F.approx_count_distinct(f"`{n}`").alias(f"d{i}") for i, n in enumerate(texts)]
        ).first()
        # The exact level list of every column that may qualify.
        near = [n for i, n in enumerate(texts) if few[f"d{i}"] <= 2 * ONE_HOT_LEVELS]
        hot = fit_encoder(source, "one_hot", near)["steps"] if near else {}
        for n in texts:
            step = hot.get(n)
            is_hot = step and step["kind"] == "one_hot" and len(step["levels"]) <= ONE_HOT_LEVELS \
                and len(step["levels"]) < few["rows"] * ONE_HOT_SHARE
            encoder["steps"][n] = step if is_hot else None
        codes = [n for n in texts if encoder["steps"][n] is None]
        if codes:
            encoder["steps"].update(fit_encoder(source, "label", codes)["steps"])
    state = {"dates": dated, "encoder": encoder, "columns": []}
    prepared = apply_features(source, state)
    state["columns"] = [
        f.name for f in prepared.schema.fields if is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType)
    ]
    return state


def apply_features(df: DataFrame, state: dict) -> DataFrame:
    """The prepared columns as numbers, aligned to the training columns, next to the original row.

    Original columns stay available under their own names unless a feature replaces them.
    """
    out = df
    for n in state["dates"]:
        if n in df.columns:
            at = as_timestamp(F.col(f"`{n}`"), df.schema[n].dataType)
            zero = F.lit(0)
            out = out.withColumns({
                f"{n}_year": F.coalesce(F.year(at), zero),
                f"{n}_month": F.coalesce(F.month(at), zero),
                f"{n}_day": F.coalesce(F.dayofmonth(at), zero),
            }).drop(n)
    out = apply_encoder(out, state["encoder"])
    have = set(out.columns)
    if "fill" in state:
        # Numbers as the learner reads them: double, missing ones replaced.
        present = [c for c in state["columns"] if c in have]
        out = nan_to_null(out, present).withColumns({
            c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(state["fill"])) for c in present
        })
    return out.withColumns({c: F.lit(0.0) for c in state["columns"] if c not in have})


def fit_native_categories(train: DataFrame, exclude: Sequence[str] = ()) -> dict:
    """Training medians for numbers, the text `missing` for categories."""
    names = [c for c in train.columns if c not in exclude]
    numeric = [n for n in names if is_numeric(train.schema[n].dataType)]
    texts = [n for n in names if is_string(train.schema[n].dataType)]
    fills = fit_fills(train, "median", numeric) if numeric else {}
    return {"fills": {**fills, **{n: MISSING_CATEGORY for n in texts}}, "numeric": numeric, "categories": texts}


def apply_native_categories(df: DataFrame, state: dict) -> DataFrame:
    filled = apply_fills(df, state["fills"])
    missing = {c: F.lit(0.0) for c in state["numeric"] if c not in df.columns}
    missing.update({c: F.lit(MISSING_CATEGORY) for c in state["categories"] if c not in df.columns})
    return filled.withColumns(missing)
