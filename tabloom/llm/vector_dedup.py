"""Near-duplicate vectors by iterative quantisation and multi-index hash tables.

A rotation is learned on a bounded sample (`sample_rows`) so that the signs of the rotated
principal components are balanced binary codes with small quantisation error. Codes are cut
into chunks, one hash table each; vectors that agree in a chunk meet in a bucket and are
compared by the cosine of the original vectors in double precision.

Recall. Two vectors agree in a bit with p = 1 - angle / pi, in a chunk of w bits with p^w. Codes
are signs of centred vectors, and centring widens the angle of a pair, by more the nearer it is
to the mean. So angles are taken after centring, over pairs at the threshold cosine around
sampled vectors (in any direction, and towards other vectors of the sample) and over linked
pairs of the sample. The number of tables is chosen so that the share of pairs of each kind that
meet in none is below 1 - `recall`, and raised until that holds for their codes too. Signs are
taken without centring where that costs less. Chunk
width grows with the logarithm of the number of vectors and is less where many tables cost
more than larger buckets. Links that are found have the threshold cosine exactly.

Buckets are cut into blocks of at most `block` vectors, and each pair of blocks is one group,
so a bucket that holds a third of all vectors is many tasks. A group returns counts and a few
links that join its components, never pairs. A pair is counted in the first table in which
it agrees. Equal vectors are one row with a weight from the start.

Edge cases: vectors that are null, empty, zero or hold null or non-finite numbers have no
links, and are their own component; vectors of another length than most of the sample are
compared only among their own length; an empty table gives an empty result; further columns
are ignored. Each row is a vector of its own, also where ids repeat or are null: it has its own
result row, other rows with its id count as other vectors, and distinct vectors are named by
numbers of their own. A component of vectors whose ids are all null has a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import written_table

from .common import components
from .vectors import matrix, stored_kind, usable, valid_vectors


def rotation(sample: np.ndarray, mean: np.ndarray, bits: int, seed: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (dimensions x bits) of the quantiser; without rounds the rotation is a random one."""
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    main = vectors[:, ::-1][:, :bits]
    projected = centred @ main
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(main.shape[1], main.shape[1])))[0]
    for _ in range(rounds):
        codes = np.where(projected @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(codes.T @ projected)
        turn = (u @ v).T
    return mean, main @ turn


def threshold_pairs(units: np.ndarray, threshold: float, most: int = 2_000, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors of each kind that recall is promised for."""
    random = np.random.default_rng(seed)
    u = units[random.permutation(len(units))[:most]]
    kinds = []
    for towards in (random.normal(size=u.shape), units[random.integers(len(units), size=len(u))]):
        aside = towards - (towards * u).sum(1)[:, None] * u
        size = np.sqrt((aside * aside).sum(1))[:, None]
        held = size[:, 0] > 1e-6
        if held.any():
            kinds.append((u[held], threshold * u[held] + math.sqrt(max(0.0, 1 - threshold * threshold)) * aside[held] / size[held]))
    i, j = [], []
    for at in range(0, len(u), 250):
        near = u[at:at + 250] @ units.T
        a, b = np.nonzero((near >= threshold) & (near < 1 - 1e-9))
        if len(a) > most // 4:
            chosen = random.permutation(len(a))[:most // 4]
            a, b = a[chosen], b[chosen]
        i.append(a + at)
        j.append(b)
    i, j = np.concatenate(i), np.concatenate(j)
    if len(i):
        kinds.append((u[i], units[j]))
    return kinds


def agreement(a: np.ndarray, b: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Chance of each pair to agree in a bit."""
    a, b = a - mean, b - mean
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return 1 - np.arccos(np.clip((a * b).sum(1) / np.maximum(size, 1e-30), -1, 1)) / math.pi


def plan(rows: int, recall: float, bits: int, kinds: list[np.ndarray], others: np.ndarray) -> tuple[float, int, int]:
    """Cost, width of a chunk and number of tables, from the chance to agree in a bit of pairs at the threshold and of any two vectors."""

    def tables_of(width: int) -> float:
        high = 1
        enough = lambda n: all(((1 - p**width) ** n).mean() <= 1 - recall for p in kinds)
        while not enough(high):
            high *= 2
            if high > 1 << 20:
                return math.inf
        low = high // 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if enough(mid) else (mid, high)
        return high

    widest = min(bits, 30, max(6, int(math.log2(max(rows, 2) / 128) + 0.5)))
    planned = [(width, tables_of(width)) for width in range(widest, 0, -1)]
    return min((tables * (128 + rows * float((others**width).mean())), width, tables) for width, tables in planned)


def share_met(pairs, quantisers, width: int, tables: int) -> float:
    """Share of the pairs whose codes agree in a table, for the kind with the least."""
    return min((float((chunk_codes(a, quantisers, width, tables) == chunk_codes(b, quantisers, width, tables)).any(1).mean()) for a, b in pairs), default=1.0)


def chunk_codes(units: np.ndarray, quantisers, width: int, tables: int) -> np.ndarray:
    """Rows x tables: the chunk of each table."""
    columns = []
    for mean, projection in quantisers:
        signs = (units - mean) @ projection >= 0
        for at in range(0, signs.shape[1] - width + 1, width):
            columns.append(signs[:, at:at + width] @ (1 << np.arange(width)))
            if len(columns) == tables:
                return np.stack(columns, axis=1).astype(np.int64)
    return np.stack(columns, axis=1).astype(np.int64)


def _least_labels(near: np.ndarray) -> np.ndarray:
    """Component number of each row of a symmetric adjacency matrix."""
    labels = np.arange(len(near))
    while True:
        lower = np.where(near, labels[None, :], len(near)).min(1)
        lower = np.minimum(lower, labels)
        lower = lower[lower]
        if (lower == labels).all():
            return labels
        labels = lower


def _compare(threshold: float, kind: str):
    """One group: two blocks (or one) of a bucket."""

    def run(rows: pa.Table) -> pa.Table:
        side, ids, weight = (rows.column(c).to_numpy() for c in ("side", "id", "weight"))
        table = rows.column("tab")[0].as_py()
        x = matrix(rows.column("vec").to_pylist(), kind)
        units = x / np.sqrt((x * x).sum(1))[:, None]
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype="<i4").reshape(len(ids), -1)
        near = units @ units.T >= threshold
        np.fill_diagonal(near, False)
        if side.any():
            near &= side[:, None] != side[None, :]
        labels = _least_labels(near)
        # A pair counts in the first table in which it agrees.
        i, j = np.nonzero(near)
        for earlier in range(table):
            first = codes[i, earlier] != codes[j, earlier]
            i, j = i[first], j[first]
        links = np.bincount(i, weights=weight[j], minlength=len(ids))
        head = ids[labels]
        keep = (links > 0) | (head != ids)
        return pa.table({"id": ids[keep], "links": links[keep].astype(np.int64), "head": head[keep]})

    return run


def link_vectors(df: DataFrame, threshold: float = 0.9, recall: float = 0.97, sample_rows: int = 20_000, block: int = 1024,
                 key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Key (long), n_links, component_id, kept for every row."""
    kind = stored_kind(df, vector)
    wide = np.dtype(kind).itemsize
    raw = valid_vectors(df, key, vector, kind)
    first = raw.groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    # Numbers that are fixed once the table is written; ids may repeat.
    reps = written_table(first.select(F.monotonically_increasing_id().alias("id"), "first", "weight", "vec"), "vectors")
    links = [reps.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("head")).limit(0)]
    spread = {r["size"]: r["n"] for r in reps.groupBy(F.length("vec").alias("size")).count().withColumnRenamed("count", "n").collect()}
    for size, rows in sorted(spread.items()):
        mine = reps.filter(F.length("vec") == size)
        share = min(1.0, 1.2 * sample_rows / rows)
        drawn = mine.filter(F.shiftrightunsigned(F.xxhash64("vec"), 2) <= int(share * 2**62)).select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample_rows)
        x = matrix([bytes(r["vec"]) for r in drawn.toLocalIterator()] or [b"\0" * size], kind)
        norm = np.sqrt((x * x).sum(1))[:, None]
        units = x / np.where(norm == 0, 1, norm)
        pairs, plans = threshold_pairs(units, threshold), []
        # Without centring no pair at the threshold is torn apart, but buckets are uneven.
        for centre in (units.mean(0), np.zeros(units.shape[1])):
            others = agreement(units, np.roll(units, 1, 0), centre)
            plans.append((plan(rows, recall, size // wide, [agreement(a, b, centre) for a, b in pairs], others), centre))
        (_, width, tables), centre = min(plans, key=lambda x: x[0][0])
        per_rotation = max(1, (size // wide) // width)
        quantisers = [rotation(units, centre, size // wide, seed) for seed in range(-(-tables // per_rotation))]
        while share_met(pairs, quantisers, width, tables) < recall:
            quantisers.append(rotation(units, centre, size // wide, len(quantisers), rounds=0))
            tables = len(quantisers) * per_rotation
        links.append(_links_of(mine, quantisers, width, tables, threshold, block, kind))
    found = links[0]
    for one in links[1:]:
        found = found.union(one)
    found = written_table(found, "links")
    groups = components(found.select(F.col("id").alias("a"), F.col("head").alias("b")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = reps.select("id", "first", "weight", "vec").join(counted, "id", "left").join(groups, F.col("id") == F.col("node"), "left").select(
        "vec", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = raw.join(named.drop("first").join(least, "component"), "vec").select(F.col("id").alias(key), "n_links", "component_id")
    alone = df.filter(~usable(vector)).select(F.col(key).cast("long").alias(key)).select(
        key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _links_of(reps: DataFrame, quantisers, width: int, tables: int, threshold: float, block: int, kind: str) -> DataFrame:
    sent = reps.sparkSession.sparkContext.broadcast(quantisers)  # a fixed size for each table

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2).to_pylist(), kind)
            codes = chunk_codes(x / np.sqrt((x * x).sum(1))[:, None], sent.value, width, tables)
            yield batch.append_column("codes", pa.array([c.astype("<i4").tobytes() for c in codes], pa.binary())).append_column("buckets", pa.array(list(codes), pa.list_(pa.int64())))

    coded = written_table(reps.select("id", "weight", "vec").mapInArrow(code, "id long, weight long, vec binary, codes binary, buckets array<long>"), "codes")
    keyed = coded.select("id", F.posexplode("buckets").alias("tab", "bucket"))
    sizes = keyed.groupBy("tab", "bucket").count().filter("count > 1").withColumn("blocks", F.ceil(F.col("count") / block))
    placed = keyed.join(sizes, ["tab", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # A vector goes to every pair of blocks that has its own.
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "tab", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).cast("long").alias("side"))
    full = dealt.join(coded.drop("buckets"), "id")
    return full.groupBy("tab", "bucket", "i", "j").applyInArrow(_compare(threshold, kind), "id long, links long, head long")
