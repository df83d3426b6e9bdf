"""Least squares per key, for any number of keys of any size.

Each task reduces the rows of a key to a triangle: the R factor of the regressors and the
target, which holds all that a fit needs in at most one row per regressor (Demmel et al., 2012).
Triangles are merged by stacking and reducing them again, first per key and part of the tasks,
then per key. So a key that holds most of the rows costs no more than any other, a short series
is sent as its few rows, and regressors that are zero in all rows of a key are not sent at all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_OPEN_CELLS = 4_000_000  # numbers a task holds before it passes its triangles on
PARTS = 64                  # groups of tasks whose triangles are merged apart


class _Triangle:
    """Rows of some columns, reduced when they are more than twice as many as the columns."""

    def __init__(self, columns: np.ndarray, rows: np.ndarray, n: int):
        self.columns, self.rows, self.n = columns, rows, n
        self._reduce()

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> _Triangle:
        whole = np.column_stack([x, y])
        used = (whole != 0).any(axis=0)
        used[-1] = True
        columns = np.flatnonzero(used)
        return cls(columns, whole[:, columns], len(y))

    def _reduce(self) -> None:
        if len(self.rows) > 2 * len(self.columns):
            self.rows = np.linalg.qr(self.rows, mode="r")

    def add(self, other: _Triangle) -> None:
        columns = np.union1d(self.columns, other.columns)
        rows = np.zeros((len(self.rows) + len(other.rows), len(columns)))
        for at, part in ((0, self), (len(self.rows), other)):
            rows[at:at + len(part.rows), np.searchsorted(columns, part.columns)] = part.rows
        self.columns, self.rows, self.n = columns, rows, self.n + other.n
        self._reduce()

    def record(self) -> tuple[int, list, list]:
        if len(self.rows) > len(self.columns):
            self.rows = np.linalg.qr(self.rows, mode="r")
        return self.n, self.columns.tolist(), self.rows.ravel().tolist()

    @classmethod
    def merged(cls, records: pd.DataFrame) -> _Triangle:
        total = None
        for n, columns, cells in zip(records["_n"], records["_columns"], records["_cells"]):
            columns = np.asarray(columns, dtype=int)
            one = cls(columns, np.asarray(cells, dtype=float).reshape(-1, len(columns)), int(n))
            if total is None:
                total = one
            else:
                total.add(one)
        return total


def fit_least_squares(
    df: DataFrame, x: str, y: str, width: int, keys: Sequence[str] = (), penalties: Sequence[float] | None = None
) -> DataFrame:
    """`(keys, n, coef array<double>, sse)` for y = x . coef.

    `x` is an array column of `width` numbers. `penalties` (one per coefficient) add a
    ridge term scaled by the number of rows. A regressor that is 0 in all rows has coefficient 0.
    """
    keys = list(keys)
    ridge = np.asarray(penalties if penalties is not None else np.zeros(width), dtype=float)
    key_fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    part_schema = T.StructType([
        *key_fields, T.StructField("_part", T.IntegerType()), T.StructField("_n", T.LongType()),
        T.StructField("_columns", T.ArrayType(T.IntegerType())), T.StructField("_cells", T.ArrayType(T.DoubleType()))])
    fields = part_schema.names

    def flush(open_: dict, part: int) -> pd.DataFrame:
        return pd.DataFrame([(*key, part, *t.record()) for key, t in open_.items()], columns=fields).astype({k: object for k in keys})

    def partial(batches):
        open_: dict = {}
        part, cells = 0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf["_part"].iloc[0])
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, rows in groups:
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(None if pd.isna(k) else k for k in key)
                one = _Triangle.of(np.vstack(rows["_x"].to_numpy()), rows["_y"].to_numpy(dtype=float))
                if key in open_:
                    cells -= open_[key].rows.size
                    open_[key].add(one)
                else:
                    open_[key] = one
                cells += open_[key].rows.size
            if cells > MAX_OPEN_CELLS:
                yield flush(open_, part)
                open_, cells = {}, 0
        if open_:
            yield flush(open_, part)

    def keyed(pdf: pd.DataFrame, values: dict) -> pd.DataFrame:
        out = pd.DataFrame({name: [value] for name, value in values.items()})
        for k in keys:
            out[k] = pdf[k].iloc[:1].to_numpy()
        return out

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n, columns, cells = _Triangle.merged(pdf).record()
        return keyed(pdf, {"_part": int(pdf["_part"].iloc[0]), "_n": n, "_columns": columns, "_cells": cells})[fields]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _Triangle.merged(pdf)
        used = total.columns[:-1]
        squares = total.rows.T @ total.rows
        gram, rhs, yy = squares[:-1, :-1], squares[:-1, -1], squares[-1, -1]
        found = np.linalg.lstsq(gram + np.diag(ridge[used]) * total.n, rhs, rcond=1e-12)[0] if len(used) else np.zeros(0)
        coef = np.zeros(width)
        coef[used] = found
        sse = max(float(yy - 2 * found @ rhs + found @ gram @ found), 0.0)
        return keyed(pdf, {"n": total.n, "coef": coef.tolist(), "sse": sse})[[*keys, "n", "coef", "sse"]]

    rows = df.select(
        *keys, F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("_part"), F.col(x).alias("_x"), F.col(y).cast("double").alias("_y")
    ).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    parts = rows.mapInPandas(partial, part_schema).groupBy(*keys, "_part").applyInPandas(merge, part_schema)
    out_schema = T.StructType([
        *key_fields, T.StructField("n", T.LongType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("sse", T.DoubleType()),
    ])
    # One group is at most `PARTS` triangles.
    return parts.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInPandas(solve, out_schema)


def dot(x, coef):
    """Native inner product of two array columns."""
    return F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
