"""Statistical outlier guard: z-score or interquartile bounds, flag or filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import names_of, requested
from ..functions.numeric import nan_to_null, percent
from .quantiles import exact_quantiles

# Default thresholds, and columns never taken as a measure.
DEFAULT_THRESHOLDS = {"z_score": 3.0, "iqr": 1.5}
FLAG_COLUMNS = ("is_anomaly", "is_outlier")


def fit_bounds(df: DataFrame, method: str = "z_score", threshold: float | None = None, columns=None) -> dict:
    """Bounds per numeric column, as plain numbers that can be applied to any other table or stream."""
    limit = DEFAULT_THRESHOLDS[method] if threshold is None else float(threshold)
    numeric = [n for n in names_of(df, "numeric") if n not in FLAG_COLUMNS]
    chosen = [n for n in requested(df, columns) if n in numeric] or ([] if requested(df, columns) else numeric)
    bounds: dict[str, dict[str, float]] = {}
    if chosen and method == "z_score":
        clean = nan_to_null(df, chosen)
        row = clean.agg(*[
            e for i, n in enumerate(chosen)
            for e in (F.avg(f"`{n}`").alias(f"m{i}"), F.stddev_samp(f"`{n}`").alias(f"s{i}"))
        ]).first()
        for i, n in enumerate(chosen):
            if row[f"m{i}"] is not None:
                spread = row[f"s{i}"]
                bounds[n] = {"mean": float(row[f"m{i}"]), "std": float(spread) if spread is not None else 0.0}
    elif chosen:
        for n, (q1, q3) in exact_quantiles(df, {n: [0.25, 0.75] for n in chosen}).items():
            if q1 is not None:
                bounds[n] = {"lower": q1 - limit * (q3 - q1), "upper": q3 + limit * (q3 - q1)}
    return {"method": method, "threshold": limit, "bounds": bounds}


def column_masks(fitted: dict) -> dict[str, Column]:
    """Per column: is the value outside its bounds? Null and NaN never are."""
    out = {}
    for n, b in fitted["bounds"].items():
        c = F.col(f"`{n}`").cast("double")
        if fitted["method"] == "z_score":
            outside = F.abs(c - F.lit(b["mean"])) / F.lit(b["std"]) > fitted["threshold"] if b["std"] > 0 else F.lit(False)
        else:
            outside = (c < b["lower"]) | (c > b["upper"])
        out[n] = F.coalesce(outside & ~F.isnan(c), F.lit(False))
    return out


def outlier_mask(fitted: dict) -> Column:
    any_ = F.lit(False)
    for mask in column_masks(fitted).values():
        any_ = any_ | mask
    return any_


def apply_bounds(df: DataFrame, fitted: dict, action: str = "flag") -> DataFrame:
    if action == "filter":
        return df.filter(~outlier_mask(fitted))
    return df.withColumn("is_outlier", outlier_mask(fitted).cast("int"))


def guard(df: DataFrame, method: str = "z_score", threshold: float | None = None, action: str = "flag",
          columns=None) -> DataFrame:
    return apply_bounds(df, fit_bounds(df, method, threshold, columns), action)


def guard_report(df: DataFrame, fitted: dict) -> DataFrame:
    """`(column, outliers, total_records, outlier_percentage)`; the row `*` is any column at once."""
    masks = column_masks(fitted)
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(outlier_mask(fitted)).alias("any"),
        *[F.count_if(m).alias(f"c{i}") for i, m in enumerate(masks.values())],
    )
    lines = [F.struct(F.lit("*").alias("column"), F.col("any").alias("outliers"))]
    lines += [F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("outliers")) for i, n in enumerate(masks)]
    return counted.select("total", F.explode(F.array(*lines)).alias("l")).select(
        "l.column",
        "l.outliers",
        F.col("total").alias("total_records"),
        F.coalesce(percent(F.col("l.outliers"), F.nullif(F.col("total"), F.lit(0))), F.lit(0.0)).alias("outlier_percentage"),
    )


def flagged_sample(df: DataFrame, order_by: list[str], flag: str = "is_outlier", limit: int = 50) -> DataFrame:
    """The first flagged rows in the given order."""
    return df.filter(F.col(flag) == 1).orderBy(*order_by).limit(limit)


def top_anomalies(df: DataFrame, score: str = "anomaly_score", key: str | None = None, limit: int = 10) -> DataFrame:
    """The highest scores; ties by key, or without one by a hash of the row, so reruns agree."""
    # Maps and variants have no hash.
    plain = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    ties = [F.col(f"`{key}`").asc()] if key else [F.xxhash64(*[F.col(f"`{c}`") for c in plain])]
    return df.orderBy(F.col(f"`{score}`").desc(), *ties).limit(limit)

