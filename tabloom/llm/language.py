"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Terms are runs of one to four characters of the lower-cased text, where every character that
is not a letter counts as a space; they are hashed to `2**bits` buckets. Document frequencies
are counted over all training rows. Weights are learned by follow-the-regularised-leader
(per-coordinate steps, L1 and L2 penalties) on a bounded sample of rows (`max_rows` for each
language, chosen by a hash of the text, copies once; a language with fewer different texts gives
all of them); a fifth of each language's sample calibrates the temperature of the probabilities,
and a language of fewer than five texts is learned from all of them.

Edge cases: a null text and one without letters are `und` with score 0; without training rows
every text is `und`; ties go to the language that sorts first; texts of any length are read
whole; equal texts have equal results; an empty table gives an empty result; further columns
are ignored when predicting and kept by `drop_unsure`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def terms(text: str | None, bits: int, longest: int = 4) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts; None without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letter_table()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    h, parts = np.zeros(len(codes), dtype=np.uint32), []
    for n in range(longest):
        if len(codes) <= n:
            break
        h = (h[:len(codes) - n] ^ codes[n:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        parts.append((h * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(32 - bits))
    counts = np.bincount(np.concatenate(parts), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    bits: int
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, text: str | None) -> np.ndarray | None:
        found = terms(text, self.bits) if self.languages else None
        return None if found is None else softmax(self.logits(*weighed(found, self.idf)) / self.temperature)

    def logits(self, at, x) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        p = self.probabilities(text)
        if p is None:
            return "und", 0.0
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def weighed(found, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = found
    x = (1 + np.log(counts)) * idf[at]
    size = math.sqrt(float(x @ x))
    return at, x / size if size else x


def document_frequencies(docs: DataFrame, bits: int, text: str) -> tuple[int, np.ndarray]:
    """Rows with letters and rows by bucket, over all rows: at most 2**bits counts from a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                found = terms(value.as_py(), bits)
                if found is not None:
                    rows += 1
                    total[found[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["bucket", "n"])

    counts, rows = np.zeros(1 << bits), 0
    for r in docs.select(text).mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            rows = r["n"]
        else:
            counts[r["bucket"]] = r["n"]
    return rows, counts


def sample(docs: DataFrame, max_rows: int, bits: int, text: str, lang: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, counts) of at most `max_rows` different texts of each language, in the order of their hash."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("y"), F.col(text).alias("t"))
    # Texts that surely hold no letter (characters unknown to Java may be letters) take no place.
    rows = rows.filter(F.col("t").rlike(r"\p{L}|\p{Cn}")).withColumn("h", F.shiftrightunsigned(F.xxhash64("t"), 2))
    sizes = rows.select("y", "h").distinct().groupBy("y").agg(F.count("*").alias("n"))
    # So much more than max_rows that a draw by hash does not fall short of it.
    share = F.least(F.lit(1.0), F.lit(1.5 * max_rows + 60) / F.col("n"))
    chosen = rows.join(F.broadcast(sizes.select("y", (share * float(2**62)).cast("long").alias("limit")).hint("broadcast")), "y")
    chosen = chosen.filter(F.col("h") <= F.col("limit")).dropDuplicates(["y", "h"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_terms = [terms(t.as_py(), bits) or (np.empty(0, np.int64), np.empty(0, np.int64)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t[0].astype(np.int32) for t in all_terms], pa.list_(pa.int32())),
                                              pa.array([t[1].astype(np.int32) for t in all_terms], pa.list_(pa.int32()))], names=["y", "h", "at", "n"])

    kept: dict[str, list] = {}
    rows = chosen.select("y", "h", "t").mapInArrow(tidy(found), "y string, h long, at array<int>, n array<int>").orderBy("h")
    for r in rows.toLocalIterator():
        mine = kept.setdefault(r["y"], [])
        if r["at"] and len(mine) < max_rows:
            mine.append((r["h"], r["y"], np.array(r["at"], dtype=np.int32), np.array(r["n"], dtype=np.int32)))
    return [x[1:] for x in sorted((x for mine in kept.values() for x in mine), key=lambda x: (x[0], x[1]))]


def learn(rows, languages: list[str], idf: np.ndarray, bits: int, passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> Model:
    """Follow-the-regularised-leader with elastic net; every fifth row of a language is kept for the temperature."""
    k, data = len(languages), [(languages.index(y), *weighed((at, n), idf)) for y, at, n in rows]
    train, rest, seen = [], [], [0] * k
    for d in data:
        seen[d[0]] += 1
        (train if seen[d[0]] % 5 else rest).append(d)
    z, g2 = np.zeros((1 << bits, k)), np.zeros((1 << bits, k))
    zb, gb = np.zeros(k), np.zeros(k)

    def current(zs, gs):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(gs)) / alpha + l2))

    for _ in range(passes):
        for y, at, x in train:
            w, wb = current(z[at], g2[at]), current(zb, gb)
            p = softmax(x @ w + wb)
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / alpha * w
            g2[at] += g * g
            zb += p - (np.sqrt(gb + p * p) - np.sqrt(gb)) / alpha * wb
            gb += p * p
    model = Model(bits, languages, idf, current(z, g2), current(zb, gb))
    scores = [(y, model.logits(at, x)) for y, at, x in rest]
    model.temperature = min((0.02 * 1.15**i for i in range(40)), key=lambda t: -sum(math.log(max(softmax(s / t)[y], 1e-12)) for y, s in scores)) if scores else 1.0
    return model


def fit(docs: DataFrame, max_rows: int = 800, bits: int = 15, text: str = "text", lang: str = "lang") -> Model:
    """Learns from the text and language of `docs`, which holds training rows only."""
    labelled = docs.filter(F.col(lang).isNotNull())
    rows = sample(labelled, max_rows, bits, text, lang)
    n, counts = document_frequencies(labelled, bits, text)
    return learn(rows, sorted({y for y, *_ in rows}), np.log((1 + n) / (1 + counts)) + 1, bits)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred, score for every row; row-wise, no shuffle. The model has a fixed number of buckets."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sent.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(tidy(predict), f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def drop_unsure(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose language is known with at least the probability `least`."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (sent.value.predict(t.as_py()) for t in batch.column(place))
            yield batch.filter(pa.array([lang != "und" and p >= least for lang, p in found], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)
