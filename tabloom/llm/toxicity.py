"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum w_t + sum over pairs <v_s, v_t>) over the distinct terms of the whole
text. The pair term, computed as half of |sum v|^2 - sum |v|^2, learns what additive weights
cannot: a word that is toxic only beside another.

Fit. A bounded sample of labelled rows (`max_rows` for each label, chosen by a hash of the
text, copies once) is turned into term numbers on the executors and learned on the driver by
stochastic gradient descent with adaptive steps; terms in fewer than `min_rows` sampled rows have
no weight. Terms about as common under either label (`least_z`) may be toxic only together, or
noise: a machine with them and one without are learned on four fifths of the sample, and the
kind with the smaller loss on the other fifth is learned from all of it (with under five rows of
a label: the one without). The intercept is corrected for the share of each label that was sampled.

Edge cases: null and empty texts score the intercept alone; without labelled rows, or with
one label only, every score is the share of label 1 (0.5 if there are no labels); equal texts
have equal scores; texts of any length are read whole; an empty table gives an empty result;
further columns are ignored when scoring and kept by `drop_toxic`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

_TERM = re.compile(r"\w+")


@dataclass
class Machine:
    """Only buckets with weights are kept."""

    bits: int
    intercept: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray  # buckets x factors

    def __post_init__(self):
        self.place = None

    def score(self, terms: np.ndarray) -> float:
        if self.place is None:
            self.place = np.full(1 << self.bits, -1, dtype=np.int32)
            self.place[self.buckets] = np.arange(len(self.buckets))
        t = self.place[terms]
        return sigmoid(self.intercept + reply(self.weights, self.factors, t[t >= 0]))


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def reply(w: np.ndarray, v: np.ndarray, t: np.ndarray) -> float:
    """Additive weights and all pairwise interactions of the terms t."""
    vt = v[t]
    total = vt.sum(0)
    return float(w[t].sum() + 0.5 * ((total * total).sum() - (vt * vt).sum()))


class Terms:
    """Distinct hashed terms of a text; remembers a bounded number of words."""

    def __init__(self, bits: int, most: int = 500_000):
        self.mask, self.most, self.known = (1 << bits) - 1, most, {}

    def of(self, text: str | None) -> np.ndarray:
        words = set(_TERM.findall((text or "").lower()))
        known, out = self.known, []
        if len(known) > self.most:
            known.clear()
        for w in words:
            h = known.get(w)
            if h is None:
                known[w] = h = zlib.crc32(w.encode("utf-8", "surrogatepass")) * 0x9E3779B1 >> 7 & self.mask
            out.append(h)
        return np.unique(np.array(out, dtype=np.int64))


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int, bits: int, key: str, text: str, label: str) -> tuple[list, dict[int, int]]:
    """[(label, terms)] of at most `max_rows` different texts of each label, and the number of all rows of each label.

    Only keys and hashes meet the labels; the chosen ones, at most `max_rows` for each label, are sent to the texts.
    """
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.shiftrightunsigned(F.xxhash64("t"), 2))
    marked = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    rows = texts.select("k", "h").join(marked, "k").groupBy("k", "h", "y").agg(F.count("*").alias("n"))
    sizes = rows.groupBy("y", "h").agg(F.sum("n").alias("n")).groupBy("y").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    counts = {r["y"]: r["n"] for r in sizes}
    # So much more than max_rows that a draw by hash does not fall short of it.
    share = {r["y"]: min(1.0, (1.25 * max_rows + 60) / r["texts"]) for r in sizes}
    kept = None
    for y, s in share.items():
        part = rows.filter((F.col("y") == y) & (F.col("h") <= int(s * 2**62))).groupBy("h", "y").agg(F.min("k").alias("k")).orderBy("h").limit(max_rows)
        kept = part if kept is None else kept.union(part)
    if kept is None:
        return [], {}

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Terms(bits)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([find.of(t.as_py()).astype(np.int32) for t in batch.column(2)], pa.list_(pa.int32()))], names=["h", "y", "terms"])

    found = texts.join(F.broadcast(kept), ["k", "h"]).select("h", "y", "t").mapInArrow(tidy(terms), "h long, y int, terms array<int>").dropDuplicates(["h", "y"])
    data = sorted(found.toLocalIterator(), key=lambda r: (r["h"], r["y"]))
    return [(r["y"], np.array(r["terms"], dtype=np.int64)) for r in data], counts


def associated(data, size: int, min_rows: int, least_z: float) -> np.ndarray:
    """Buckets whose share of rows differs between the labels by `least_z` standard errors; others are noise in long texts."""
    seen = [np.bincount(np.concatenate([t for y, t in data if y == label]), minlength=size) for label in (0, 1)]
    n = [sum(y == label for y, _ in data) for label in (0, 1)]
    both = (seen[0] + seen[1] + 1) / (n[0] + n[1] + 2)
    z = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    return np.flatnonzero((seen[0] + seen[1] >= min_rows) & (np.abs(z) >= least_z))


def loss(machine: Machine, data) -> float:
    """Mean log loss, both labels weighing the same."""
    each: dict[int, list[float]] = {0: [], 1: []}
    for y, t in data:
        p = machine.score(t)
        each[y].append(-math.log(max(p if y else 1 - p, 1e-12)))
    return sum(sum(x) / len(x) for x in each.values() if x)


def learn(data, counts: dict[int, int], bits: int, least_z: float = 3.0, **options) -> Machine:
    """The machine of the terms (all, or those that differ by `least_z`) that do better on every fifth row of each label."""
    parts, seen = ([], []), {0: 0, 1: 0}
    for y, t in data:
        seen[y] += 1
        parts[seen[y] % 5 == 0].append((y, t))
    if min(seen.values()) >= 5:
        level = {0: 1, 1: 1}  # scores as if both labels were equally common
        least_z = min((least_z, 0.0), key=lambda z: loss(_learn(parts[0], level, bits, least_z=z, **options), parts[1]))
    return _learn(data, counts, bits, least_z=least_z, **options)


def _learn(data, counts: dict[int, int], bits: int, factors: int = 4, passes: int = 8, step: float = 0.2,
           shrink: float = 1e-4, min_rows: int = 4, least_z: float = 3.0, seed: int = 7) -> Machine:
    if len({y for y, _ in data}) < 2:
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        return Machine(bits, math.log(max(share, 1e-6) / max(1 - share, 1e-6)), np.empty(0, np.int64), np.empty(0), np.empty((0, factors)))
    buckets = associated(data, 1 << bits, min_rows, least_z)
    place = np.full(1 << bits, -1)
    place[buckets] = np.arange(len(buckets))
    data = [(y, place[t][place[t] >= 0]) for y, t in data]
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(buckets)), random.normal(0, 0.01, (len(buckets), factors))
    gw, gv, gb, b = np.full(w.shape, 1e-2), np.full(v.shape, 1e-1), 1e-2, 0.0
    positive = sum(y for y, _ in data)
    heavy = (len(data) - positive) / positive  # both labels weigh the same while learning
    for _ in range(passes):
        for i in random.permutation(len(data)):
            y, t = data[i]
            error = (sigmoid(b + reply(w, v, t)) - y) * (heavy if y else 1.0)
            gb += error * error
            b -= step * error / math.sqrt(gb)
            if len(t):
                g = error + shrink * w[t]
                gw[t] += g * g
                w[t] -= step * g / np.sqrt(gw[t])
                vt = v[t]
                g = error * (vt.sum(0) - vt) + shrink * vt
                gv[t] += g * g
                v[t] = vt - step * g / np.sqrt(gv[t])
    # From equal weight of both labels back to their share among all labelled rows.
    return Machine(bits, b + math.log(counts[1] / counts[0]), buckets, w, v)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, bits: int = 20, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    return learn(*sampled(docs, labels, max_rows, bits, key, text, label), bits)


def toxicity_scores(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and score for every row; row-wise, no shuffle. The machine has a fixed size (2**bits buckets)."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        find = Terms(m.bits)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(find.of(t.as_py())) for t in batch.column(1)], pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(tidy(score), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def held_out(key: str, parts: int, rest: int):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == rest, F.lit(False))


def drop_toxic(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", most: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose score is below `most`."""
    place = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        find = Terms(m.bits)
        for batch in batches:
            yield batch.filter(pa.array([m.score(find.of(t.as_py())) < most for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)
