"""Exact quantiles and modes that never gather a large column in one task.

Spark's `percentile` keeps every distinct value of the column in one aggregation
buffer. That is fine for some ten thousand distinct values; beyond that the
wanted ranks are first bracketed by `approx_percentile`, and the exact values are
picked inside the bracket, with the rows below it only counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import is_fractional

MAX_DISTINCT = 50_000
ACCURACY = 20_000
COLUMNS_PER_PASS = 16


def _value(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if is_fractional(df.schema[name].dataType):
        c = F.when(~F.isnan(c), c)
    return c.cast("double")


def exact_quantiles(
    df: DataFrame, wanted: dict[str, Sequence[float]], max_distinct: int = MAX_DISTINCT
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, nulls and NaN ignored; None for empty columns."""
    if not wanted:
        return {}
    names = list(wanted)
    slim = df.select(*[_value(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    stats = slim.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))],
        *[F.approx_count_distinct(f"v{i}").alias(f"d{i}") for i in range(len(names))],
    ).first()
    out: dict[str, list[float | None]] = {}
    direct = [i for i in range(len(names)) if stats[f"n{i}"] and stats[f"d{i}"] <= max_distinct]
    if direct:
        row = slim.agg(
            *[F.percentile(f"v{i}", F.array(*[F.lit(float(q)) for q in wanted[names[i]]])).alias(f"p{i}")
              for i in direct]
        ).first()
        out.update({names[i]: list(row[f"p{i}"]) for i in direct})
    out.update({n: [None] * len(wanted[n]) for i, n in enumerate(names) if not stats[f"n{i}"]})
    rest = [i for i, n in enumerate(names) if n not in out]
    for start in range(0, len(rest), COLUMNS_PER_PASS):
        part = rest[start:start + COLUMNS_PER_PASS]
        found = _bracketed(
            slim, {f"v{i}": wanted[names[i]] for i in part}, {f"v{i}": stats[f"n{i}"] for i in part}, max_distinct
        )
        out.update({names[i]: found[f"v{i}"] for i in part})
    return {n: out[n] for n in names}


def _bracketed(
    slim: DataFrame, wanted: dict[str, Sequence[float]], sizes: dict[str, int], max_distinct: int
) -> dict[str, list[float]]:
    """Quantiles of columns with many distinct values; all columns and ranks share each pass."""
    slack = 4.0 / ACCURACY
    ranks = {
        c: sorted({r for q in qs for r in (math.floor((sizes[c] - 1) * q), math.ceil((sizes[c] - 1) * q))})
        for c, qs in wanted.items()
    }
    ends = slim.agg(*[e for c, rs in ranks.items() for e in (
        F.min(c).alias(f"lo_{c}"),
        F.max(c).alias(f"hi_{c}"),
        F.percentile_approx(
            c, [min(1.0, max(0.0, r / sizes[c] + s)) for r in rs for s in (-slack, slack)], ACCURACY
        ).alias(f"p_{c}"),
    )]).first()
    low, high = {c: ends[f"lo_{c}"] for c in ranks}, {c: ends[f"hi_{c}"] for c in ranks}
    # Ranks next to the ends fall outside an approximate bracket: extend it to the end itself.
    brackets = {
        (c, r): (
            low[c] if r / sizes[c] <= slack else ends[f"p_{c}"][2 * j],
            high[c] if r / sizes[c] >= 1 - slack else ends[f"p_{c}"][2 * j + 1],
        )
        for c, rs in ranks.items() for j, r in enumerate(rs)
    }
    values: dict[tuple[str, int], float] = {}
    while len(values) < len(brackets):
        open_ = [k for k in brackets if k not in values]
        counts = slim.agg(*[e for k in open_ for e in _bracket_counts(*k, *brackets[k])]).first()
        pick, narrow = [], []
        for c, r in open_:
            lo, hi = brackets[c, r]
            below, inside = counts[f"b_{c}_{r}"], counts[f"i_{c}_{r}"]
            if not below <= r < below + inside:
                brackets[c, r] = (low[c], lo) if r < below else (hi, high[c])
            elif lo == hi:
                values[c, r] = lo
            elif counts[f"d_{c}_{r}"] <= max_distinct:
                pick.append((c, r, (r - below + 0.5) / inside))
            else:
                narrow.append((c, r, (r - below) / inside))
        if pick:
            row = slim.agg(*[
                F.expr(
                    f"percentile_disc({share!r}) WITHIN GROUP (ORDER BY CASE WHEN {c} >= {_double(brackets[c, r][0])}"
                    f" AND {c} <= {_double(brackets[c, r][1])} THEN {c} END)"
                ).alias(f"r_{c}_{r}")
                for c, r, share in pick
            ]).first()
            values.update({(c, r): row[f"r_{c}_{r}"] for c, r, _ in pick})
        if narrow:
            row = slim.agg(*[
                F.percentile_approx(
                    F.when(F.col(c).between(*brackets[c, r]), F.col(c)),
                    [max(0.0, share - slack), min(1.0, share + slack)],
                    ACCURACY,
                ).alias(f"r_{c}_{r}")
                for c, r, share in narrow
            ]).first()
            for c, r, share in narrow:
                lo, hi = row[f"r_{c}_{r}"]
                brackets[c, r] = (
                    brackets[c, r][0] if share <= slack else lo,
                    brackets[c, r][1] if share >= 1 - slack else hi,
                )
    out = {}
    for c, qs in wanted.items():
        out[c] = []
        for q in qs:
            at = (sizes[c] - 1) * q
            a, b = values[c, math.floor(at)], values[c, math.ceil(at)]
            out[c].append(a + (b - a) * (at - math.floor(at)))
    return out


def _double(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _bracket_counts(column: str, rank: int, lo: float, hi: float) -> list[Column]:
    c = F.col(column)
    inside = c.between(lo, hi)
    return [
        F.count_if(c < lo).alias(f"b_{column}_{rank}"),
        F.count_if(inside).alias(f"i_{column}_{rank}"),
        F.approx_count_distinct(F.when(inside, c)).alias(f"d_{column}_{rank}"),
    ]


def value_counts(df: DataFrame, columns: Sequence[str], with_null: bool = False) -> DataFrame:
    """Long table `(column, value, n)`: one pass over the data, values as text.

    The partial counts are taken before the shuffle, so a value that fills most of
    a column costs one row per task.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
    ]))
    long = df.select(pairs.alias("p")).select("p.column", "p.value")
    if not with_null:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest one on a tie; None for empty columns.

    Counted per value and shuffled by value; no task holds a whole column.
    """
    if not columns:
        return {}
    counts = value_counts(df, columns)
    best = counts.agg(*[
        F.min(F.when(
            F.col("column") == c,
            F.struct((-F.col("n")).alias("m"), F.col("value").cast(df.schema[c].dataType).alias("v")),
        )).alias(f"b{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: best[f"b{i}"]["v"] if best[f"b{i}"] is not None else None for i, c in enumerate(columns)}


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """`(column, rank, value, n)` for the `k` most frequent values, smaller value first on a tie.

    Ranked first within salted parts of each column, then among the survivors, so
    a column with very many values is not ranked by a single task.
    """
    counts = value_counts(df, columns)
    order = [F.col("n").desc(), F.col("value").asc()]
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(256)))
    part = Window.partitionBy("column", "_salt").orderBy(*order)
    survivors = salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k)
    whole = Window.partitionBy("column").orderBy(*order)
    return (
        survivors.withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= k)
        .select("column", "rank", "value", "n")
    )
