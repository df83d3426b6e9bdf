"""Codes of vectors: one byte per part from codebooks refined in integers, entries found by LAESA.

A component x becomes floor(256 * x); vectors are cut into equal parts, each with its own
codebook, started from the vectors of the smallest ids. LAESA: a few pivots per part are
fixed before the first round, chosen among the first entries for the greatest sum of
distances, and each part's distances to them are computed once and kept with it. In a
round only the distances from pivots to entries are new. By the triangle inequality
|d(part, pivot) - d(entry, pivot)|, the greatest over the pivots, is a lower bound; the
entry with the smallest bound is measured first, and of the others only those whose bound
does not exceed that distance are measured, exactly, in integers. The bounds carry a slack
for rounding, and an entry at the same distance is always measured, so ties go to the
lower index as with a full search.

A round is one pass: tasks send the sum and count of each entry's parts, and parts x
entries rows (a fixed number) reach the driver, which divides. Equal labels are added up
in salted groups, so one label may hold any share of the rows.

Edge cases: rows whose vector is null, or holds null or non-finite numbers, are dropped.
The length of vectors is that of the smallest id whose vector can be cut into equal parts;
rows of another length (empty ones among them) are dropped too. Null ids come last when
the first entries are chosen, equal ids follow their vectors. With fewer vectors than
entries the codebooks are smaller. Components of 2**18 or more cannot be summed exactly
and are refused with an error. An empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import written_table

from .common import spread_join

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 6
SCALE = 256
LIMIT = 2**26


@dataclass(frozen=True)
class Codebooks:
    """`entries`: parts x entries x width; `pivots`: parts x pivots x width; all integers."""

    entries: np.ndarray
    pivots: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()


def integers(numbers: np.ndarray) -> np.ndarray:
    out = np.floor(numbers.astype("<f8") * SCALE)
    if out.size and np.abs(out).max() >= LIMIT:
        raise ValueError(f"components of {LIMIT // SCALE} or more cannot be summed exactly")
    return out.astype("<i8")


def choose_pivots(first: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Per part: the first entry, then each time the entry with the greatest sum of distances to the pivots so far."""
    out = []
    for part in first:
        chosen, total = [0], np.zeros(len(part))
        while len(chosen) < min(count, len(part)):
            total += np.sqrt(((part - part[chosen[-1]]) ** 2).sum(axis=1))
            total[chosen] = -1.0
            chosen.append(int(total.argmax()))
        out.append(part[chosen])
    return np.stack(out)


def pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """rows x parts x pivots, single precision; `rows` is rows x parts x width."""
    gaps = rows[:, :, None, :] - pivots[None]
    return np.sqrt((gaps * gaps).sum(axis=3)).astype("<f4")


def nearest_entries(rows: np.ndarray, near: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of every part, rows x parts, and how many distances were measured."""
    n, parts, _ = rows.shape
    codes, best, measured = np.zeros((n, parts), "<i8"), np.zeros((n, parts), "<i8"), 0
    if n == 0:
        return codes, best, 0
    for j in range(parts):
        own, entries = rows[:, j], books.entries[j]
        to_entries = pivot_distances(entries[:, None, :], books.pivots[j][None])[:, 0]
        bound = np.zeros((n, len(entries)), "<f4")
        for p in range(to_entries.shape[1]):
            np.maximum(bound, np.abs(near[:, j, p, None] - to_entries[None, :, p]), out=bound)
        gaps = own - entries[bound.argmin(axis=1)]
        radius = np.sqrt((gaps * gaps).sum(axis=1)) + 1e-6 * (1.0 + near[:, j].max() + to_entries.max())
        who, entry = np.nonzero(bound <= radius[:, None])
        gaps = own[who] - entries[entry]
        far = (gaps * gaps).sum(axis=1)
        measured += n + len(who)
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        best[:, j] = np.minimum.reduceat(far, starts)
        hits = np.flatnonzero(far == best[who, j])
        codes[:, j] = entry[hits[np.r_[True, who[hits][1:] != who[hits][:-1]]]]
    return codes, best, measured


def _usable(df: DataFrame, key: str, vector: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """Rows (id, label, vec) whose vector takes part, and the length of their vectors."""
    v = F.col(vector)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = df.filter(fine).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), v.alias("vec"))
    even = rows.filter((F.size("vec") > 0) & (F.size("vec") % parts == 0))
    first = even.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.size("vec").alias("width"))).alias("m")).first()["m"]
    width = first["width"] if first else 0
    return rows.filter(F.size("vec") == width) if width else rows.limit(0), width


def train_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks | None]:
    """The table (id, label, ints, near) written once, and the codebooks after the last round (None without vectors)."""
    rows, width = _usable(df, key, vector, label, parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    label_type = df.schema[label].dataType.simpleString()
    if not first:
        return df.sparkSession.createDataFrame([], f"id long, label {label_type}, ints binary, near binary"), None
    start = integers(np.array([r["vec"] for r in first], "<f8")).reshape(len(first), parts, -1).transpose(1, 0, 2)
    books = Codebooks(start, choose_pivots(start, pivots))
    fixed = books.pivots

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = integers(batch.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, parts, -1)
            near = pivot_distances(whole, fixed)
            ints = whole.astype("<i4").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in ints], pa.binary()),
                 pa.array([r.tobytes() for r in near.reshape(batch.num_rows, -1)], pa.binary())], names=["id", "label", "ints", "near"])

    table = written_table(rows.mapInArrow(prepare, f"id long, label {label_type}, ints binary, near binary"), "parts")
    for _ in range(rounds):
        books = Codebooks(_refined(table, books), fixed)
    return table, books


def _unpacked(ints, near, parts: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ints)
    rows = np.frombuffer(b"".join(ints.to_pylist()), "<i4").astype("<i8").reshape(n, parts, -1)
    return rows, np.frombuffer(b"".join(near.to_pylist()), "<f4").reshape(n, parts, -1)


def _refined(table: DataFrame, books: Codebooks) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts nearest to it."""
    parts, entries, width = books.entries.shape
    sums = [f"s{i}" for i in range(width)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, "<i8"), np.zeros((parts * entries, width), "<i8")
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, near = _unpacked(batch.column(0), batch.column(1), parts)
            codes, _, _ = nearest_entries(rows, near, books)
            slot = (codes + np.arange(parts) * entries).ravel()
            count += np.bincount(slot, minlength=len(count))
            order = np.argsort(slot, kind="stable")
            cut = np.flatnonzero(np.r_[True, slot[order][1:] != slot[order][:-1]])
            total[slot[order][cut]] += np.add.reduceat(rows.reshape(-1, width)[order], cut, axis=0)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *[pa.array(total[used, i]) for i in range(width)]],
                                             names=["slot", "n", *sums])

    sent = table.select("ints", "near").mapInArrow(assign, "slot long, n long, " + ", ".join(f"{s} long" for s in sums))
    out = books.entries.reshape(-1, width).copy()
    for r in sent.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect():
        out[r["slot"]] = [r[s] // r["n"] for s in sums]
    return out.reshape(parts, entries, width)


def encode_vectors(table: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code as bytes, error) by the given codebooks."""
    label_type = table.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, near = _unpacked(batch.column(2), batch.column(3), books.entries.shape[0])
            codes, far, _ = nearest_entries(rows, near, books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes.astype("u1")], pa.binary()),
                                              pa.array(far.sum(axis=1))], names=["id", "label", "code", "error"])

    return table.mapInArrow(assign, f"id long, label {label_type}, code binary, error long")


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """vec_id, code in hex, error, label_error, codebooks_sha256."""
    table, books = train_codes(df, key, vector, label, **options)
    if books is None:
        coded, digest = table.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), ""
    else:
        coded, digest = written_table(encode_vectors(table, books), "codes"), books.sha256()
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return spread_join(coded, totals, ["label"], ["id", "code"]).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by a full search in SQL, for vectors of one length."""
    far = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT id, part, any_value(p.v) AS v, min({far}::BIGINT * {entries} + c.e) AS m
            FROM p JOIN c{r} c USING (part) GROUP BY id, part)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT part, e, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM (
                SELECT part, m % {entries} AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, (SELECT max(len(v)) + 1 FROM p)) x(i)
                GROUP BY 1, 2, 3) GROUP BY part, e)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(s.v, c.v) AS v FROM c{r} c LEFT JOIN s{r} s USING (part, e))")
    return f"""
WITH k AS (SELECT vec_id AS id, label, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS MATERIALIZED (SELECT id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v FROM k, range({parts}) x(part)),
  f AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM k ORDER BY id LIMIT {entries}),
  c0 AS MATERIALIZED (SELECT part, e, v FROM f JOIN p USING (id)),
  {', '.join(steps)},
  book AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds}),
  coded AS (SELECT id, string_agg(printf('%02x', (m % {entries})::INTEGER), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN (SELECT id, label FROM k) USING (id), book"""
