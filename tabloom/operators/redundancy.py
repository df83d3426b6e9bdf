"""Columns that carry no information of their own: near-copies and constants."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import names_of
from ..functions.numeric import nan_to_null
from .ordered import MAX_TASK_ROWS
from .quantiles import value_counts
from .rank_correlation import spearman_pairs

PAIRS_PER_PASS = 400


def correlation_pairs(
    df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None, max_task_rows: int = MAX_TASK_ROWS
) -> list[tuple[str, str, float | None]]:
    """`(earlier, later, correlation)` over the rows where both are known.

    Pearson: all pairs in one aggregate (a few hundred per pass). Spearman: average
    ranks of all pairs from one long table.
    """
    names = list(columns or names_of(df, "numeric"))
    clean = nan_to_null(df.select(*[F.col(f"`{n}`") for n in names]), names)
    if method == "spearman":
        return spearman_pairs(clean, names, max_task_rows)
    if method != "pearson":
        raise ValueError(f"unknown correlation method: {method}")
    return _pearson_pairs(clean, list(combinations(names, 2)))


def _correlation(a: str, b: str) -> Column:
    """Like `corr`, but null instead of a division error when a column is constant."""
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x))) * F.sqrt(F.var_pop(F.when(both, y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def _pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str, float | None]]:
    out = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[start:start + PAIRS_PER_PASS]
        row = df.agg(*[_correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(part)]).first()
        for i, (a, b) in enumerate(part):
            r = row[f"r{i}"]
            out.append((a, b, None if r is None or r != r else r))
    return out


def correlated_columns(pairs, threshold: float = 0.95) -> list[str]:
    """Columns whose absolute correlation with any earlier column exceeds the threshold."""
    hit = [later for _, later, r in pairs if r is not None and abs(r) > threshold]
    return list(dict.fromkeys(hit))


def correlation_filter(df: DataFrame, threshold: float = 0.95, method: str = "pearson") -> DataFrame:
    return df.drop(*correlated_columns(correlation_pairs(df, method), threshold))


def dominant_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`(column, dominant_share)`: share of the most frequent value, null counting as a value.

    Ranked within salted parts first; only one count per part meets in the end.
    """
    counts = value_counts(df, list(columns or df.columns), with_null=True)
    parts = counts.groupBy("column", F.pmod(F.xxhash64("value"), F.lit(256)).alias("_salt")).agg(
        F.max("n").alias("top"), F.sum("n").alias("rows")
    )
    return parts.groupBy("column").agg((F.max("top") / F.sum("rows")).alias("dominant_share"))


def dominated_columns(df: DataFrame, max_dominant_percentage: float = 0.99) -> list[str]:
    """Columns in which one value covers at least the given share of the rows.

    Above one half, such a value must be the median of the hashed values, so two
    passes of map-side aggregates decide without shuffling any column: find that
    hash, then count it.
    """
    names = df.columns
    if max_dominant_percentage <= 0.55:
        rows = dominant_shares(df).filter(F.col("dominant_share") >= max_dominant_percentage).collect()
        hit = {r["column"] for r in rows}
        return [n for n in names if n in hit]
    # 52 bits of the hash: quantiles work on doubles, which hold those exactly.
    hashed = df.select(*[F.shiftright(F.xxhash64(F.col(f"`{n}`").isNull(), F.col(f"`{n}`")), 12).alias(f"h{i}")
                         for i, n in enumerate(names)])
    middle = hashed.agg(*[F.percentile_approx(f"h{i}", 0.5, 1000).alias(f"m{i}") for i in range(len(names))]).first()
    if middle is None or middle["m0"] is None:
        return []
    counted = hashed.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f"h{i}") == F.lit(middle[f"m{i}"])).alias(f"c{i}") for i in range(len(names))],
    ).first()
    return [n for i, n in enumerate(names) if counted[f"c{i}"] / counted["rows"] >= max_dominant_percentage]


def variance_filter(df: DataFrame, max_dominant_percentage: float = 0.99) -> DataFrame:
    return df.drop(*dominated_columns(df, max_dominant_percentage))
