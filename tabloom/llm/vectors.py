"""Helpers for vectors as binary columns of 64-bit floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors that are not null or empty, hold no null or non-finite number, and are not all zero; never null."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(v) > 0)
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def valid_vectors(df: DataFrame, key: str, vector: str, kind: str = "<f8") -> DataFrame:
    """(id, vec): rows whose vector is not null or empty and holds no null or non-finite number, nor only zeros.

    `vec` holds the original numbers, little-endian, as doubles or as `kind` says. Native up to the packing into bytes.
    """
    rows = df.filter(usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) for x in column)])
            packed = [flat[a:b].astype(kind).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "vec"])

    return rows.mapInArrow(to_bytes, "id long, vec binary")


def stored_kind(df: DataFrame, vector: str) -> str:
    """The smallest number type that holds the vectors' numbers exactly."""
    return "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"


def matrix(packed: list[bytes], kind: str = "<f8") -> np.ndarray:
    """Rows of doubles."""
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype("<f8", copy=False)
