"""Nearest neighbours by collision counting on single projections.

Each vector is projected on `projections` random lines; of each line the sorted projections
are kept. A query opens a window of half-width radius on every line, centred on itself, and
counts for each vector the lines on which it falls inside. A vector with at least `threshold`
of the lines is verified by its Euclidean distance. The radius grows by the factor `growth` (2 while all counts are low)
until the k-th verified
distance is below it, or the windows hold everything. Counts only grow with the radius, so the
radius at which this ends is the first of the series for which it holds, and is looked for from
the one of the query before; a count compares the ranks of all vectors on the lines with the
windows. A vector within the radius falls into a
window with the normal distribution's 68 %, so with 128 lines and a threshold of 0.6 it is
missed with a chance of some 2 %.

Rows are dealt by hash to blocks of about `block` vectors, queries to chunks; each (block,
chunk) is one group with its own sorted arrays, and the best k of all blocks are merged.

Edge cases: vectors that are null, empty, zero or hold null or non-finite numbers take no
part; only vectors of equal length are compared; a query with fewer than k candidates gets all of
them; ties go to the smaller id, then to the earlier row of the written table, null ids last.
Each row is a vector of its own: rows that repeat an id are candidates of each other, and each
row of a repeated query id has its own k result rows. A null id is never a query. An empty table, or one without queries, gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import written_table

from .vectors import matrix, valid_vectors


class Lines:
    """Sorted projections of a block of vectors; the arrays of all lines stand one behind the other."""

    def __init__(self, x: np.ndarray, projections: int, seed: int = 11):
        self.x, self.directions = x, np.random.default_rng(seed).normal(size=(x.shape[1], projections))
        values = (x @ self.directions).T
        order = np.argsort(values, axis=1, kind="stable")
        reach = 2 * float(np.abs(values).max()) + 1
        self.shift = reach * np.arange(projections)
        self.values = (np.take_along_axis(values, order, axis=1) + self.shift[:, None]).ravel()
        self.first = len(x) * np.arange(projections)
        # Place of each vector on each line, in the smallest type that also holds their number.
        kind = np.min_scalar_type(len(x))
        self.ranks = np.empty((projections, len(x)), dtype=kind)
        np.put_along_axis(self.ranks, order, np.arange(len(x), dtype=kind)[None, :], axis=1)
        self.moved, self.met = np.empty_like(self.ranks), np.empty(self.ranks.shape, dtype=bool)
        self.lengths = (x * x).sum(1)
        # Radii at which the last query stopped doubling, and stopped.
        self.doubled = self.stopped = 0.0

    def counts(self, at: np.ndarray, radius: float) -> np.ndarray:
        """For each vector the number of lines on which it lies within the radius of `at`."""
        kind, last = self.ranks.dtype, self.first + len(self.x)
        left = np.clip(np.searchsorted(self.values, at - radius, "left"), self.first, last)
        right = np.clip(np.searchsorted(self.values, at + radius, "right"), left, last)
        # Ranks below the window wrap around to large numbers.
        np.subtract(self.ranks, (left - self.first).astype(kind)[:, None], out=self.moved)
        np.less(self.moved, (right - left).astype(kind)[:, None], out=self.met)
        return np.add.reduce(self.met.view(np.uint8), axis=0, dtype=np.min_scalar_type(len(at)))

    def first_that(self, holds, radii: list[float], factor: float, guess: float) -> int:
        """Index of the first radius that `holds`, which stays so for larger ones; `radii` is made longer by `factor`."""
        def radius(i: int) -> float:
            while len(radii) <= i:
                radii.append(radii[-1] * factor)
            return radii[i]

        i = max(0, round(math.log(guess / radii[0], factor))) if guess > radii[0] else 0
        step, low, high = 1, -1, None
        while high is None or high - low > 1:
            if holds(radius(i)):
                high = i
            else:
                low = i
            if high is None:
                i, step = low + step, step * 2
            elif low < 0 and high == i and high > 0:
                i, step = max(0, high - step), step * 2
            else:
                i = (low + high) // 2
        return high

    def nearest(self, q: np.ndarray, k: int, threshold: float, growth: float, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and distances of the candidates verified, without those surely farther than k others; `skip` marks rows that are no candidates."""
        n, m = len(self.x), self.directions.shape[1]
        at, need, last = q @ self.directions + self.shift, max(1, int(threshold * m)), self.first + n
        rest, measured, length = np.flatnonzero(~skip), np.full(n, np.nan), float(q @ q)
        if not len(rest):
            return rest, np.empty(0)
        lo = np.clip(np.searchsorted(self.values, at), self.first, last)
        # The first window holds k vectors on an average line.
        near = np.minimum(np.abs(self.values[np.maximum(lo - k, self.first)] - at), np.abs(self.values[np.minimum(lo + k, last - 1)] - at))
        start = max(float(np.median(near)), 1e-9)
        counted: dict[float, np.ndarray] = {}
        best: dict[float, tuple[np.ndarray, np.ndarray]] = {}

        def met(radius: float) -> np.ndarray:
            if radius not in counted:
                counted[radius] = self.counts(at, radius)
            return counted[radius]

        def ends(radius: float) -> bool:
            found = rest[met(radius)[rest] >= need]
            new = found[np.isnan(measured[found])]
            if len(new):
                measured[new] = self.lengths[new] + length - 2 * (self.x[new] @ q)
            # Rounding of these squares is far below the slack, which is infinite if they overflow.
            some, slack = found, 1e-9 * (length + self.lengths[found].max(initial=0.0))
            if len(found) > k and np.isfinite(slack):
                squares = measured[found]
                some = found[squares <= np.partition(squares, k - 1)[k - 1] + slack]
            distances = np.sqrt(((self.x[some] - q) ** 2).sum(1))
            best[radius] = some, distances
            return len(found) == len(rest) or len(found) >= k and np.partition(distances, k - 1)[k - 1] <= radius

        doubled = [start]
        doublings = self.first_that(lambda r: met(r).max() > need // 2 or bool((met(r)[rest] >= need).all()), doubled, 2.0, self.doubled)
        # Radii that double may end it as well.
        if ends(doubled[doublings]):
            stop = doubled[self.first_that(ends, doubled[:doublings + 1], 2.0, doubled[doublings])]
        else:
            radii = [doubled[doublings]]
            stop = radii[self.first_that(ends, radii, growth, self.stopped)]
        self.doubled, self.stopped = doubled[doublings], stop
        return best[stop]


def _search(k: int, projections: int, threshold: float, growth: float):
    def run(rows: pa.Table) -> pa.Table:
        role, number = rows.column("role").to_numpy(), rows.column("row").to_numpy()
        names = rows.column("id")
        ids, known = names.fill_null(np.iinfo(np.int64).max).to_numpy(), names.is_valid().to_numpy()
        vectors = rows.column("vec").to_pylist()
        out: list[tuple] = []
        data, queries = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if len(data) and len(queries):
            lines, own = Lines(matrix([vectors[i] for i in data]), projections), number[data]
            for i in queries:
                at, distance = lines.nearest(np.frombuffer(vectors[i], "<f8"), k, threshold, growth, own == number[i])
                best = np.lexsort((own[at], ids[data[at]], distance))[:k]
                found = data[at[best]]
                out += [(number[i], ids[i], number[f], ids[f] if known[f] else None, d) for f, d in zip(found, distance[best])]
        columns = list(zip(*out)) or [()] * 5
        names = ("query_row", "query_id", "row", "vec_id", "score")
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(names, columns)})

    return run


def nearest_neighbours(df: DataFrame, is_query, k: int = 10, projections: int = 128, threshold: float = 0.6, growth: float = 1.2,
                       block: int = 4096, chunk: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's k nearest found among the other rows.

    `is_query` is a condition on the key.
    """
    rows = valid_vectors(df, key, vector).withColumnRenamed("id", key).withColumn("query", F.coalesce(is_query, F.lit(False)) & F.col(key).isNotNull())
    # Row numbers that are fixed once the table is written.
    rows = written_table(rows.withColumnRenamed(key, "id").withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.col("query").cast("long")).alias("q")).first()
    blocks, chunks = max(1, -(-size["n"] // block)), max(1, -(-(size["q"] or 0) // chunk))
    every_chunk, every_block = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (chunks, blocks))
    dealt = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    data = rows.select("row", "id", "vec", F.lit(0).alias("role"), F.length("vec").alias("size"), dealt(blocks, "block").alias("block"), every_chunk.alias("chunk"))
    asked = rows.filter("query").select("row", "id", "vec", F.lit(1).alias("role"), F.length("vec").alias("size"), every_block.alias("block"), dealt(chunks, "chunk").alias("chunk"))
    found = data.union(asked).groupBy("size", "block", "chunk").applyInArrow(
        _search(k, projections, threshold, growth), "query_row long, query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
