"""Duplicate rows: keep first, keep last, drop every member, or flag.

Everything is an aggregate by the compared columns, so copies are merged inside
the map tasks before the shuffle: a group that holds a large share of all rows
reaches the reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import requested

STRATEGIES = ("drop_first", "drop_last", "drop_all", "flag_only")


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def remove_duplicates(
    df: DataFrame,
    strategy: str = "drop_first",
    subset_columns=None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Nulls count as equal. `order_by` says which row is first; without it the
    kept row is any one of the group."""
    subset = requested(df, subset_columns) or list(df.columns)
    if strategy == "flag_only":
        return flag_duplicates(df, subset)
    rest = [c for c in df.columns if c not in subset]
    if strategy != "drop_all" and not rest:
        return df.dropDuplicates()
    grouped = df.groupBy(*_cols(subset))
    if strategy == "drop_all":
        keep = [F.any_value(F.struct(*_cols(rest))).alias("_row")] if rest else []
        once = grouped.agg(F.count(F.lit(1)).alias("_n"), *keep).filter(F.col("_n") == 1)
        return once.select(*[F.col(f"_row.`{c}`").alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns])
    if not order_by:
        return df.dropDuplicates(subset)
    # Nulls sort last, as in the row order the caller means.
    at = F.struct(*[e for o in _cols(order_by) for e in (o.isNull(), o)])
    edge = F.max_by if strategy == "drop_last" else F.min_by
    kept = grouped.agg(edge(F.struct(*_cols(rest)), at).alias("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns])


def flag_duplicates(df: DataFrame, subset_columns=None, name: str = "is_duplicate") -> DataFrame:
    """1 for every member of a repeated group.

    Counts are pre-aggregated; the join back goes by a hash of the compared columns
    (checked by value) and only against the groups that do repeat. Hot groups are
    split by the adaptive skew join.
    """
    subset = requested(df, subset_columns) or list(df.columns)
    repeated = (
        df.groupBy(*_cols(subset)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        .select(
            F.xxhash64(*_cols(subset)).alias("_h"),
            *[F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(subset)],
            F.lit(1).alias("_hit"),
        )
    )
    hashed = df.withColumn("_g", F.xxhash64(*_cols(subset)))
    on = F.col("_g") == F.col("_h")
    for i, c in enumerate(subset):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"_d{i}"))
    flagged = hashed.join(repeated, on, "left")
    return flagged.select(*_cols(df.columns), F.coalesce(F.col("_hit"), F.lit(0)).alias(name))


def duplicate_report(df: DataFrame, strategy: str = "drop_first", subset_columns=None) -> DataFrame:
    """One row: original, final and removed row counts, from a single aggregate by group."""
    subset = requested(df, subset_columns) or list(df.columns)
    groups = df.groupBy(*_cols(subset)).agg(F.count(F.lit(1)).alias("n"))
    survivors = {
        "flag_only": F.sum("n"),
        "drop_all": F.count_if(F.col("n") == 1),
    }.get(strategy, F.count(F.lit(1)))
    counted = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("original_rows"), F.coalesce(survivors, F.lit(0)).alias("final_rows")
    )
    return counted.withColumn("rows_removed", F.col("original_rows") - F.col("final_rows")).withColumn(
        "strategy", F.lit(strategy)
    )
