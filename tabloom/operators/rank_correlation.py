"""Rank correlation of all pairs of columns from one long table of ranked values.

Ranks are taken among the rows where both columns of a pair are known. A column therefore has
one ranking of its own, and one more for each other column that has nulls. All rankings are
melted into rows `(ranking, value)`, equal values are counted, one pass of running sums over the
counts gives every average rank, and the ranks come back to their rows by a join: a broadcast for
rankings with few different values, else shuffled by value. If all are broadcast the rows stay where
they are, else the ranks are shuffled by row. Columns that are null in the same rows share rankings. The rows then add up to a Gram matrix of the rankings: each task sends its sums for the wanted
pairs only.

The number of jobs depends neither on the columns nor on the nulls, no task holds a column, and
what reaches the driver is one number per pair and ranking. Ranks are centred, (n + 1) / 2 being
their mean, so the sums keep their digits on long tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_table
from ..sources.tables import fill_cores
from .ordered import MAX_TASK_ROWS, running_sums

ROW = "_row"
# Kinds of numbers that a double may not hold exactly.
LOSSY = (T.LongType, T.DecimalType)
# Different values (28 bytes each) up to this number are broadcast.
MAX_BROADCAST_ROWS = 200_000


def _value(name: str, dtype: T.DataType) -> tuple[Column, Column]:
    """Two doubles that order like the value: its double, and what the double lost."""
    c = F.col(f"`{name}`")
    number = c.cast("double")
    if not isinstance(dtype, LOSSY):
        return number, F.lit(0.0)
    wide = T.DecimalType(38, dtype.scale if isinstance(dtype, T.DecimalType) else 0)
    lost = c.cast(wide) - number.try_cast(wide)
    return number, F.coalesce(lost.cast("double"), F.lit(0.0))


def _missing_alike(df: DataFrame, names: Sequence[str], missing: dict[str, int]) -> dict[str, str | None]:
    """For each column the first one that is null in the same rows; None where nothing is missing.

    Only columns with equal numbers of nulls are compared, all by one aggregate.
    """
    pairs = [(a, b) for a, b in combinations([n for n in names if missing[n]], 2) if missing[a] == missing[b]]
    apart = df.agg(*[F.count_if(F.col(f"`{a}`").isNull() != F.col(f"`{b}`").isNull()).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else ()
    alike = {n: n if missing[n] else None for n in names}
    for (a, b), rows in zip(pairs, apart):
        if not rows and alike[b] == b:
            alike[b] = alike[a]
    return alike


def _rankings(names: Sequence[str], alike: dict[str, str | None]) -> dict[tuple[str, str], tuple[str, str | None]]:
    """The ranking of each column beside each other one: (column, other), ranks of the column among the
    rows where the other, if any, is known. Columns that miss values in the same rows share rankings."""
    return {(n, o): (n, None if alike[o] == alike[n] else alike[o]) for n in names for o in names if o != n}


def _gram(size: int, cells: list[tuple[int, int]]):
    """Sums of products of the wanted pairs of rankings; the entries of a row follow each other."""
    left, right = (np.array(side, dtype=np.int64) for side in zip(*cells))

    def products(rows: np.ndarray, rankings: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        matrix = np.zeros((1 + np.count_nonzero(np.diff(rows)), size))
        matrix[np.concatenate([[0], np.cumsum(np.diff(rows) != 0)]), rankings] = ranks
        return (matrix.T @ matrix)[left, right]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros(len(left)), None
        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                part = [np.concatenate(both) for both in zip(held, part)]
            if not len(part[0]):
                continue
            # The last row may go on in the next batch.
            cut = np.searchsorted(part[0] == part[0][-1], True)
            if cut:
                sums += products(*[c[:cut] for c in part])
            held = [c[cut:] for c in part]
        if held is not None:
            sums += products(*held)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(left)), pa.int64()), pa.array(sums)], names=["cell", "total"])

    return add


def spearman_pairs(
    df: DataFrame, names: Sequence[str], max_task_rows: int = MAX_TASK_ROWS, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> list[tuple[str, str, float | None]]:
    """`(earlier, later, correlation)`; None for a constant column and for pairs never known together.

    NaN must be null already. Equal values share their average rank.
    """
    pairs = list(combinations(names, 2))
    if not pairs:
        return []
    types = {n: df.schema[n].dataType for n in names}
    known = {n: F.col(f"`{n}`").isNotNull() for n in names}
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)]).first()
    beside = _rankings(names, _missing_alike(df, names, {n: counts["rows"] - counts[f"c{i}"] for i, n in enumerate(names)}))
    rankings = list(dict.fromkeys([*[(n, None) for n in names], *beside.values()]))
    number = {r: i for i, r in enumerate(rankings)}

    # Doubles alone hold most kinds of numbers.
    order = ["num", "low"] if any(isinstance(t, LOSSY) for t in types.values()) else ["num"]
    key = ["ranking", *order]
    entries = []
    for (n, other), i in number.items():
        num, low = _value(n, types[n])
        wanted = known[n] if other is None else known[n] & known[other]
        entries.append(F.when(wanted, F.struct(F.lit(i).alias("ranking"), num.alias("num"), *([low.alias("low")] if "low" in key else []))))

    def long(rows: DataFrame, chosen: Sequence[int] = range(len(rankings))) -> DataFrame:
        melted = F.explode(F.filter(F.array(*[entries[i] for i in chosen]), lambda e: e.isNotNull())).alias("e")
        return rows.select(ROW, melted).select(ROW, *[f"e.{k}" for k in key])

    numbered = fill_cores(df.select(*[F.col(f"`{n}`") for n in names])).withColumn(ROW, F.monotonically_increasing_id())
    values = written_table(long(numbered).groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "ranked_values")
    # One row per ranking, whose number is set by the columns.
    stored = {r["ranking"]: r for r in values.groupBy("ranking").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values")).collect()}
    middle = F.array(*[F.lit((stored[i]["n"] + 1) / 2.0 if i in stored else 0.0) for i in range(len(rankings))])[F.col("ranking")]
    before = running_sums(values, {"_before": F.col("n")}, order, ["ranking"], max_task_rows)
    ranks = before.select(*key, (F.col("_before") + (F.col("n") + 1) / 2.0 - middle).alias("rank"))
    # Rankings with few different values are broadcast, the smallest first, as many as fit together.
    few, held = [], 0
    for i, r in sorted(stored.items(), key=lambda item: (item[1]["values"], item[0])):
        if held + r["values"] <= max_broadcast_rows:
            few, held = [*few, i], held + r["values"]
    many = [i for i in stored if i not in few]
    if not many:
        ranked = long(numbered).join(F.broadcast(ranks), key)
    else:
        # The row numbers are written, as a task that is run again might number its rows anew.
        rows = written_table(numbered, "ranked_rows")
        ranked = long(rows, many).join(ranks.filter(F.col("ranking").isin(many)).hint("shuffle_merge"), key)
        if few:
            ranked = ranked.unionByName(long(rows, few).join(F.broadcast(ranks.filter(F.col("ranking").isin(few))), key))
        ranked = ranked.repartition(ROW).sortWithinPartitions(ROW)
    ranked = ranked.select(ROW, "ranking", "rank")

    sides = [(number[beside[a, b]], number[beside[b, a]]) for a, b in pairs]
    cells = list(dict.fromkeys([(i, i) for s in sides for i in s] + sides))
    totals = ranked.mapInArrow(_gram(len(rankings), cells), "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    found = {cells[r["cell"]]: r["total"] for r in totals.collect()}
    out = []
    for (a, b), (i, j) in zip(pairs, sides):
        spread = math.sqrt(found.get((i, i), 0.0) * found.get((j, j), 0.0))
        out.append((a, b, max(-1.0, min(1.0, found[i, j] / spread)) if spread else None))
    return out
