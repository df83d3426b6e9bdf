"""Profile of a table: one row per table, one row per column, feature schema of training data."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import is_datetime, is_numeric
from ..functions.numeric import nan_to_null, percent
from .orderstats import OrderStatistics
from .quantiles import exact_quantiles, top_values, value_counts

# Rules for the inferred column type, and parts of the quality score.
CATEGORICAL_LEVELS = 20
CATEGORICAL_SHARE = 0.05
MISSING_WEIGHT, MISSING_CAP = 1.5, 50.0
DUPLICATE_CAP = 30.0
SCHEMA_CATEGORIES = 30
TOP_K = 5

COLUMN_SCHEMA = (
    "position int, name string, inferred_type string, raw_dtype string, null_count long, null_percentage double, "
    "unique_count long, cardinality_ratio double, mean double, std double, min double, p25 double, median double, "
    "p75 double, max double, zeros_count long, negative_count long, mode string, "
    "top_values array<struct<value:string,count:long,percentage:double>>"
)


def _cols(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def row_fingerprint(df: DataFrame) -> list[Column]:
    """128 bits that tell rows apart: two hashes over the values and the pattern of nulls."""
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in _cols(df)])
    return [F.xxhash64(nulls, *_cols(df)).alias("_f1"), F.xxhash64(F.lit(7), *reversed(_cols(df)), nulls).alias("_f2")]


def duplicate_count(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row `(rows, duplicate_rows)`: rows beyond the first of each group.

    Groups by the row fingerprint, so that 16 bytes per distinct row are shuffled
    instead of whole rows; `exact=True` groups by the values themselves.
    """
    keys = _cols(df) if exact else row_fingerprint(df)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")
    )


def memory_estimate(df: DataFrame) -> Column:
    """Bytes of the values: fixed width per number, byte length per text."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        else:
            size = size + F.lit({"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(
                f.dataType.simpleString(), 8))
    return F.coalesce(F.sum(size), F.lit(0))


def table_profile(df: DataFrame, exact_duplicates: bool = False) -> DataFrame:
    """One lazy row: counts, missing cells, duplicates, memory estimate, quality score (0-100).

    Missing cells, memory and duplicates come out of the same single aggregation by row.
    """
    clean = nan_to_null(df, df.columns)
    missing = F.lit(0).cast("long")
    for c in _cols(clean):
        missing = missing + c.isNull().cast("long")
    keys = _cols(clean) if exact_duplicates else row_fingerprint(clean)
    groups = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(missing).alias("missing"), memory_estimate(clean).alias("bytes")
    )
    total = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("memory_bytes"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("total_missing_cells"),
    )
    width = len(df.columns)
    rows = F.nullif(F.col("row_count"), F.lit(0))
    total = total.withColumns({
        "column_count": F.lit(width),
        "duplicate_percentage": F.coalesce(percent(F.col("duplicate_rows"), rows), F.lit(0.0)),
        "missing_cells_percentage": F.coalesce(percent(F.col("total_missing_cells"), rows * width), F.lit(0.0)),
    })
    return total.withColumn("quality_score", quality_score(F.col("missing_cells_percentage"), F.col("duplicate_percentage")))


def quality_score(missing_percentage: Column, duplicate_percentage: Column) -> Column:
    lost = F.least(missing_percentage * MISSING_WEIGHT, F.lit(MISSING_CAP)) + F.least(
        duplicate_percentage, F.lit(DUPLICATE_CAP))
    return F.greatest(F.bround(F.lit(100.0) - lost, 1), F.lit(0.0))


def _even(x: float, digits: int) -> float:
    """Statistics are rounded the way numpy rounds: half to even of the scaled value."""
    return float(np.round(x, digits))


def inferred_type(dtype: T.DataType, known: int, unique: int | None) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_numeric(dtype):
        return "numeric"
    if is_datetime(dtype):
        return "datetime"
    if known == 0:
        return "empty"
    if unique <= CATEGORICAL_LEVELS or unique / known < CATEGORICAL_SHARE:
        return "categorical"
    return "text"


def profile_lines(df: DataFrame, approximate: bool = False, quantiles: bool = True, distinct: Sequence[str] | None = None) -> tuple[int, list[dict]]:
    """Rows of the table, and the lines of `column_profile`; each also says whether a number has a fraction (`fractional`)."""
    clean = nan_to_null(df, df.columns)
    fields = clean.schema.fields
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        exprs.append(F.count(c).alias(f"n{i}"))
        if approximate:
            exprs.append(F.approx_count_distinct(c).alias(f"d{i}"))
        if is_numeric(f.dataType):
            x = c.cast("double")
            exprs += [F.avg(x).alias(f"avg{i}"), F.stddev_samp(x).alias(f"sd{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                      F.count_if(x == 0).alias(f"z{i}"), F.count_if(x < 0).alias(f"neg{i}"), F.bool_or(x % 1 != 0).alias(f"frac{i}")]
            if approximate:
                exprs.append(F.percentile_approx(x, [0.25, 0.5, 0.75]).alias(f"q{i}"))
    s = clean.agg(*exprs).first()
    rows = s["rows"]
    if rows == 0:
        return 0, []
    others = [f.name for f in fields if not is_numeric(f.dataType)]
    exact = [] if approximate else [n for n in numeric if quantiles or distinct is None or n in distinct]
    stats = OrderStatistics(clean, [*others, *exact], in_order=quantiles or not approximate and distinct is None)
    tops = stats.top(TOP_K, others) if stats.table is not None else {}
    quartiles = stats.quantiles({n: [0.25, 0.5, 0.75] for n in exact}) if quantiles else {}
    out = []
    for i, f in enumerate(fields):
        known = s[f"n{i}"]
        unique, top = stats.distinct.get(f.name), tops.get(f.name, [])
        if approximate:
            unique = s[f"d{i}"]
        kind = inferred_type(f.dataType, known, unique)
        line = {
            "position": i, "name": f.name, "inferred_type": kind, "raw_dtype": f.dataType.simpleString(),
            "null_count": rows - known, "null_percentage": round((rows - known) / rows * 100.0, 2),
            "unique_count": unique, "cardinality_ratio": None if unique is None else round(unique / rows, 4),
            "fractional": bool(is_numeric(f.dataType) and s[f"frac{i}"]),
        }
        if kind == "numeric" and known:
            q = s[f"q{i}"] if approximate else quartiles.get(f.name)
            line.update(
                mean=_even(s[f"avg{i}"], 4), std=_even(s[f"sd{i}"], 4) if known > 1 else 0.0,
                min=s[f"lo{i}"], max=s[f"hi{i}"], zeros_count=s[f"z{i}"], negative_count=s[f"neg{i}"],
            )
            if q:
                line.update(zip(("p25", "median", "p75"), (_even(x, 4) for x in q)))
        elif kind in ("categorical", "text", "boolean") and top:
            line["mode"] = top[0][1]
            line["top_values"] = [(v, n, _even(n / rows * 100.0, 2)) for n, v in top]
        out.append(line)
    return rows, out


def column_profile(df: DataFrame, approximate: bool = False, quantiles: bool = True, distinct: Sequence[str] | None = None) -> DataFrame:
    """One row per column: type, missing, distinct, numeric statistics or top values.

    The table is read twice whatever the number of columns: one aggregate for counts and
    moments, and one count of values, from which distinct counts, quartiles and top values
    are taken (`orderstats`). With `approximate`, distinct counts and quantiles come from
    sketches; without `quantiles` their columns stay null. `distinct` names the numeric
    columns whose values are to be counted (default all): without quantiles the others'
    distinct counts, and all top values, stay null and nothing is written.
    """
    schema = T.StructType.fromDDL(COLUMN_SCHEMA)
    _, lines = profile_lines(df, approximate, quantiles, distinct)
    return df.sparkSession.createDataFrame([tuple(line.get(n) for n in schema.names) for line in lines], schema)


def top_value_report(df: DataFrame, columns: Sequence[str], k: int = TOP_K) -> DataFrame:
    """`(column, rank, value, n, percentage)`, percentages of all rows including nulls."""
    rows = df.count()
    return top_values(df, columns, k).withColumn("percentage", percent(F.col("n"), F.lit(rows)))


def column_report(profile: DataFrame) -> DataFrame:
    """Readable report: Column, Type, Null Count, Null %, Unique Count, Stats."""
    numbers = F.concat(
        F.lit("mean="), F.col("mean"), F.lit(", std="), F.col("std"), F.lit(", min="), F.col("min"),
        F.lit(", median="), F.col("median"), F.lit(", max="), F.col("max"),
    )
    tops = F.concat(F.lit("top: "), F.array_join(
        F.transform("top_values", lambda t: F.concat(t["value"], F.lit(" ("), t["count"], F.lit(")"))), ", "))
    return profile.orderBy("position").select(
        F.col("name").alias("Column"),
        F.col("inferred_type").alias("Type"),
        F.col("null_count").alias("Null Count"),
        F.col("null_percentage").alias("Null %"),
        F.col("unique_count").alias("Unique Count"),
        F.coalesce(numbers, tops, F.lit("")).alias("Stats"),
    )


FEATURE_SCHEMA = (
    "position int, name string, data_type string, min_value double, max_value double, median_value double, "
    "mean_value double, allowed_categories array<string>, default_value string"
)


def feature_schema(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """What a scoring request must look like: ranges of numbers, the smallest 30 levels of
    categories, and a default per feature (together: a sample payload)."""
    spark = df.sparkSession
    names = [n for n in (features or df.columns) if n in df.columns]
    clean = nan_to_null(df, names)
    numeric = [n for n in names if is_numeric(df.schema[n].dataType)]
    other = [n for n in names if n not in numeric]
    lines = {}
    if numeric:
        s = clean.agg(*[e for i, n in enumerate(numeric) for x in [F.col(f"`{n}`").cast("double")]
                        for e in (F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"avg{i}"))]).first()
        mid = exact_quantiles(clean, {n: [0.5] for n in numeric})
        for i, n in enumerate(numeric):
            lo, hi, avg, med = s[f"lo{i}"], s[f"hi{i}"], s[f"avg{i}"], mid[n][0]
            med = round(0.0 if med is None else med, 2)
            lines[n] = ("numeric", round(0.0 if lo is None else lo, 2), round(100.0 if hi is None else hi, 2), med,
                        round(0.0 if avg is None else avg, 2), None, str(med))
    if other:
        part = Window.partitionBy("column", "_salt").orderBy("value")
        small = (
            value_counts(clean, other).withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(256)))
            .withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= SCHEMA_CATEGORIES)
            .groupBy("column").agg(F.slice(F.array_sort(F.collect_list("value")), 1, SCHEMA_CATEGORIES).alias("v"))
        )
        seen = {r["column"]: r["v"] for r in small.collect()}
        for n in other:
            levels = seen.get(n, [])
            lines[n] = ("categorical", None, None, None, None, levels, levels[0] if levels else "Unknown")
    return spark.createDataFrame([(i, n, *lines[n]) for i, n in enumerate(names)], FEATURE_SCHEMA)
