"""Word vectors by factorising the table of words that occur near each other.

Neighbours within `window` words are counted over all texts, by a 64-bit number for each word that
no other word has, and every pair is weighed once for both directions; a cell of the word-by-word table is
the positive pointwise mutual information of the two words, less ln(shift). Its leading
eigenvectors are found by randomised subspace iteration: a random sign per word and dimension, a
hash of the word, stands for the random start, so it is never stored. Only square matrices of
(dimensions + extra) numbers a side, and the numbers of the `HEAD` most frequent words, reach the
driver, whatever the number of words, and no word is left out unless `min_count` says so.

Pairs travel and lie in blocks, arrays packed into bytes. A block belongs to a part of the words
(by hash) and holds the pairs of its words with more frequent ones, so a very frequent word has a
long run nowhere. The `HEAD` most frequent words are numbered by rank and known to every task; of
the rest a task knows the words of its part. A pair of two other words is held in both their parts.
Multiplying the table by one row of numbers per word joins the blocks of a part with the rows of its
words; what it adds to words of other parts is summed within the task and sent as blocks.

Edge cases: null and empty texts have no words and the zero vector; a word without a positive cell
has no vector and counts as zero in a text's mean; when the table has fewer independent
directions than dimensions, the rest are zeros; pairs are counted in stretches of words that overlap,
so a text of any length is counted piece by piece. Runs agree up to rounding.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import drop_written, setting, shuffles_dropped, tidy, written_table

#: Words whose pairs a task counts at once, and pairs (counted with repeats) for each part.
WORDS_PER_STRETCH = 1 << 20
PAIRS_PER_PART = 1 << 22
#: So many frequent words are known to every task.
HEAD = 1 << 18
#: Words whose rows travel together, and bytes sent to Python at once.
ROWS_TOGETHER, BYTES_AT_ONCE = 1 << 12, 8 << 20
#: Bytes that the numbers of the frequent words may take in a round, and those of word vectors that are broadcast to texts.
HEAD_BYTES, COMMON_BYTES = 32 << 20, 8 << 20
EXTRA = 10
# Directions with less than this share of the largest are rounding errors.
NEGLIGIBLE = 1e-10
BLOCKS = "part long, kind int, data binary"


def text_words(c: Column) -> Column:
    return words(F.lower(F.coalesce(c, F.lit(""))))


def _packed(*arrays: np.ndarray) -> bytes:
    """The arrays as bytes: of each number first all first bytes, then all second ones, compressed."""
    head = b"".join(struct.pack("<cq", x.dtype.char.encode(), x.size) for x in arrays)
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(x.size, x.itemsize).T.tobytes() for x in arrays)
    return struct.pack("<i", len(arrays)) + head + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpacked(data: bytes) -> list[np.ndarray]:
    kinds = [struct.unpack_from("<cq", data, 4 + 9 * i) for i in range(struct.unpack_from("<i", data)[0])]
    kinds = [(np.dtype(kind.decode()), size) for kind, size in kinds]
    total, at, out = sum(t.itemsize * size for t, size in kinds), 0, []
    planes = np.frombuffer(pa.decompress(data[4 + 9 * len(kinds):], total, codec="zstd", asbytes=True) if total else b"", np.uint8)
    for dtype, size in kinds:
        end = at + size * dtype.itemsize
        out.append(np.ascontiguousarray(planes[at:end].reshape(dtype.itemsize, size).T).view(dtype).ravel())
        at = end
    return out


def _block_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])


def _joined(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The arrays of several blocks, each with its likes."""
    return [np.concatenate(x) for x in zip(*pieces)]


@dataclass
class Head:
    """The most frequent words by rank: their numbers, how many neighbours each has, and these as a table by number."""

    ids: np.ndarray
    of: np.ndarray
    by_id: np.ndarray = field(init=False)

    def __post_init__(self):
        self.by_id = np.argsort(self.ids)

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        """The rank of each number, -1 of those that are not among them."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        sorted_ids = self.ids[self.by_id]
        at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
        return np.where(sorted_ids[at] == ids, self.by_id[at], -1)


@dataclass
class Neighbours:
    """`pairs`: (a, b, n), numbers of two words, the smaller first, and how often they are neighbours (a word beside itself once);
    `words`: (id, word, of_word), each word's number and how many neighbours it has in all.

    `blocks`: the pairs in `parts` parts, as (part, kind, data). Kind 1: of words of the part, or of frequent words, with more
    frequent words; kind 2: of words of the part with words that are not frequent either, held once for each of the two.
    """

    words: DataFrame
    blocks: DataFrame
    head: object
    parts: int
    written: list[DataFrame]

    def drop(self) -> None:
        """Gives the disk back; nothing of it can be read afterwards."""
        drop_written(*self.written)

    @property
    def pairs(self) -> DataFrame:
        head = self.head

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for kind, a, b, n, _, _ in _pairs_in(batches, head.value):
                once = a >= b if kind == 2 else np.ones(len(a), bool)
                a, b, n = a[once], b[once], n[once]
                yield from _in_rows([np.minimum(a, b), np.maximum(a, b), n], ["a", "b", "n"])

        return self.blocks.mapInArrow(read, "a long, b long, n long")

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """The words in place of their numbers."""
        for c in columns:
            names = self.words.select(F.col("id").alias(c), F.col("word").alias("_name"))
            df = df.join(names, c).withColumn(c, F.col("_name")).drop("_name")
        return df


def _in_rows(columns: list[np.ndarray], names: list[str], at_once: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), at_once):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + at_once]) for c in columns], names=names)


def _runs(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _cells_of(kind: int, data: bytes, head: Head) -> tuple:
    """Kind 1: (rank or -1, number, neighbours, run length) of the words with pairs, and (rank, n) of each pair.
    Kind 2: (own number, neighbours, run length), and (number, neighbours, n) of each pair."""
    x = _unpacked(data)
    if kind == 2:
        return tuple(x)
    top, ids, of, length, b, n = x
    return (np.concatenate([top.astype(np.int64), np.full(len(ids), -1)]), np.concatenate([head.ids[top], ids]),
            np.concatenate([head.of[top], of]), length, b, n)


def _pairs_in(batches: Iterator[pa.RecordBatch], head: Head) -> Iterator[tuple]:
    """(kind, a, b, n, neighbours of a, neighbours of b) of each block; kind 2 in one direction, `a` a word of the part."""
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
            if kind == 1:
                _, ids, of, length, b, n = _cells_of(kind, data.as_py(), head)
                other, of_other = head.ids[b], head.of[b]
            else:
                ids, of, length, other, of_other, n = _cells_of(kind, data.as_py(), head)
            yield kind, np.repeat(ids, length), other, n.astype(np.int64), np.repeat(of, length), of_other


def _both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    """`(word, context, n)` and `more` in both directions; a word next to itself counts twice."""

    def cell(word, context, n):
        return F.struct(F.col(word).alias("word"), F.col(context).alias("context"), n.alias("n"), *more)

    ways = F.when(F.col("a") == F.col("b"), F.array(cell("a", "b", F.col("n") * 2))).otherwise(F.array(cell("a", "b", F.col("n")), cell("b", "a", F.col("n"))))
    return pairs.select(F.explode(ways).alias("c")).select("c.*")


def _number(word: Column, turn: int) -> Column:
    return F.xxhash64(word, F.lit(turn))


def _parts_of(ids: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _counted_words(listed: DataFrame, window: int) -> DataFrame:
    """(word, of_word): the neighbours of every word of the lists `w`; each task counts before it sends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            column = batch.column(0)
            words_in, length = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(words_in):
                continue
            at = np.arange(len(words_in)) - np.repeat(_runs(length), length)
            beside = np.minimum(at, window) + np.minimum(np.repeat(length, length) - 1 - at, window)
            coded = words_in.dictionary_encode()
            sums = np.bincount(coded.indices.to_numpy(zero_copy_only=False), beside, len(coded.dictionary)).astype(np.int64)
            held.append(pa.table({"word": coded.dictionary, "of_word": sums}))
            rows += held[-1].num_rows
            if rows > 1 << 20:
                held = [_summed_words(held)]
                rows = 0
                if held[0].num_rows > 1 << 20:
                    yield from held.pop().to_batches(max_chunksize=100_000)
        if held:
            yield from _summed_words(held).to_batches(max_chunksize=100_000)

    sent = listed.mapInArrow(tidy(count), "word string, of_word long")
    return sent.groupBy("word").agg(F.sum("of_word").alias("of_word"))


def _summed_words(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word").aggregate([("of_word", "sum")]).rename_columns(["word", "of_word"])


def _sum_by(keys: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of `keys` (not negative, the first sorts first) and the sum of `n` of each."""
    if not len(n):
        return [*keys, n]
    bits = [int(k.max()).bit_length() for k in (*keys, n)]
    total = np.zeros(len(n), np.int64)
    for k, wide in zip(keys, bits):
        total = total << wide | k
    if sum(bits) < 64:
        # Fits one number: the counts are sorted along.
        total = total << bits[-1] | n
        total.sort()
        n, total = total & ((1 << bits[-1]) - 1), total >> bits[-1]
    else:
        order = np.argsort(total, kind="stable") if sum(bits[:-1]) < 64 else np.lexsort(keys[::-1])
        n, keys = n[order], [k[order] for k in keys]
        total = np.cumsum(np.concatenate([[0], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    first = np.flatnonzero(np.concatenate([[True], total[1:] != total[:-1]]))
    n = np.add.reduceat(n, first)
    if sum(bits) >= 64:
        return [*(k[first] for k in keys), n]
    total, out = total[first], []
    for wide in bits[-2::-1]:
        out.append(total & ((1 << wide) - 1))
        total = total >> wide
    return [*out[::-1], n]


def _stretch_pairs(ids: np.ndarray, text: np.ndarray, own: int, window: int, head: Head, parts: int) -> list[tuple[int, int, bytes]]:
    """Blocks of the pairs whose first word is among the first `own`: of two frequent words, of one, and of none."""
    names, code = np.unique(ids, return_inverse=True)
    rank = head.ranks(names)
    order = np.argsort(np.where(rank < 0, len(head.ids) + np.arange(len(names)), rank), kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    code, names, rank = place[code], names[order], rank[order]
    tops = int((rank >= 0).sum())
    wide, keys = int(len(names)).bit_length(), []
    for k in range(1, window + 1):
        x, y = code[:-k][:own], code[k:][:own]
        same = text[:-k][:own] == text[k:][:own]
        keys.append((np.maximum(x, y) << wide | np.minimum(x, y))[same])
    keys = np.concatenate(keys)
    keys.sort()
    if not len(keys):
        return []
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n, keys = np.diff(np.append(first, len(keys))), keys[first]
    a, b = keys >> wide, keys & ((1 << wide) - 1)
    n = n.astype(np.uint32)
    rows = []
    for part, at in _cut(_parts_of(names, parts)[a]):
        own_a, own_b, own_n = a[at], b[at], n[at]
        both = slice(0, int(np.searchsorted(own_a, tops)))
        rest = own_a[both.stop:], own_b[both.stop:], own_n[both.stop:]
        one = rest[1] < tops
        starts, lengths = np.unique(rest[0][one], return_counts=True)
        rows.append((part, 1, _packed(
            rank[own_a[both]].astype(np.uint32), rank[own_b[both]].astype(np.uint32), own_n[both],
            names[starts], lengths.astype(np.uint32), rank[rest[1][one]].astype(np.uint32), rest[2][one],
            names[rest[0][~one]], names[rest[1][~one]], rest[2][~one])))
    return rows


def _met(window: int, head: object, parts: int, stretch: int):
    """Of lists of words' numbers, the pairs within `window` of each other, in blocks."""

    def flush(held):
        ids, text = _joined(held)
        for at in range(0, len(ids), stretch):
            end = at + stretch + window
            rows = _stretch_pairs(ids[at:end], text[at:end], stretch, window, head.value, parts)
            for k in range(0, len(rows), 64):
                yield _block_rows(rows[k:k + 64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, 0
        for batch in batches:
            column = batch.column(0)
            length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            held.append([ids, np.repeat(np.arange(seen, seen + len(length)), length)])
            size, seen = size + len(ids), seen + len(length)
            if size >= stretch:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _word_blocks(table: DataFrame, head: object, parts: int, *more: str) -> DataFrame:
    """Blocks of kind 0: of the words that are not among the most frequent, the numbers and `more`."""

    def flush(held):
        ids, *rest = _joined(held)
        keep = np.flatnonzero(head.value.ranks(ids) < 0)
        for part, at in _cut(_parts_of(ids[keep], parts)):
            yield _block_rows([(part, 0, _packed(*(x[keep[at]] for x in (ids, *rest))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= WORDS_PER_STRETCH:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return table.select("id", *more).mapInArrow(run, BLOCKS)


def _cut(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every part and the places of its rows, in their order."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.uint16) if part.max() < 1 << 16 else part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(part[lo]), order[lo:hi]


def _by_part(run: Callable[[int, dict[int, list[bytes]]], Iterator[tuple[int, int, bytes]]], rows: DataFrame, last: Callable | None = None,
             tasks: int | None = None) -> DataFrame:
    """`run` of every part: its number and its blocks by kind; `last` gives what a task has kept over its parts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}
        for batch in batches:
            for p, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if p != part:
                    if held:
                        for row in run(part, held):
                            yield _block_rows([row])
                    part, held = p, {}
                held.setdefault(kind, []).append(data.as_py())
        if held:
            for row in run(part, held):
                yield _block_rows([row])
        if last is not None:
            for row in last():
                yield _block_rows([row])

    dealt = rows.repartition("part") if tasks is None else rows.repartition(tasks, "part")
    return dealt.sortWithinPartitions("part", "kind").mapInArrow(tidy(each), BLOCKS)


def _sorted_words(blocks: list[bytes]) -> list[np.ndarray]:
    found = _joined([_unpacked(x) for x in blocks])
    order = np.argsort(found[0])
    return [x[order] for x in found]


def _merged(parts: int):
    """Of a part's words and pairs: the pairs with frequent words, summed, and the others, which go to the part of their second word."""

    def run(part, held):
        ids, of = _sorted_words(held[0]) if 0 in held else (np.empty(0, np.int64), np.empty(0, np.int64))
        if 1 not in held:
            return
        top_a, top_b, top_n, own, length, b, n, two_a, two_b, two_n = _joined([_unpacked(x) for x in held[1]])
        a = np.repeat(np.searchsorted(ids, own), length)
        x, y, sums = _sum_by([top_a.astype(np.int64), top_b.astype(np.int64)], top_n.astype(np.int64))
        a, b, n = _sum_by([a, b.astype(np.int64)], n.astype(np.int64))
        tops, top_length = np.unique(x, return_counts=True)
        some, length = np.unique(a, return_counts=True)
        yield part, 1, _packed(tops.astype(np.uint32), ids[some], of[some], np.concatenate([top_length, length]).astype(np.uint32),
                               np.concatenate([y, b]).astype(np.uint32), np.concatenate([sums, n]).astype(np.uint32 if max(sums.max(initial=0), n.max(initial=0)) < 1 << 32 else np.int64))
        others, code = np.unique(two_b, return_inverse=True)
        a, b, n = _sum_by([np.searchsorted(ids, two_a), code], two_n.astype(np.int64))
        for to, at in _cut(_parts_of(others, parts)[b]):
            yield to, 3, _packed(ids[a[at]], of[a[at]], others[b[at]], n[at])

    return run


def _both_parts(parts: int):
    """Pairs of words that are not frequent, in the part of the second: held there and, the other way round, in the part of the first."""

    def run(part, held):
        if 3 not in held:
            return
        ids, of = _sorted_words(held[0])
        a, of_a, b, n = _joined([_unpacked(x) for x in held[3]])
        of_b = of[np.searchsorted(ids, b)]
        yield part, 2, _grouped(b, of_b, a, of_a, n)
        two = np.flatnonzero(a != b)
        for to, at in _cut(_parts_of(a[two], parts)):
            at = two[at]
            yield to, 2, _grouped(a[at], of_a[at], b[at], of_b[at], n[at])

    return run


def _grouped(own, of_own, other, of_other, n) -> bytes:
    order = np.argsort(own, kind="stable")
    ids, first, length = np.unique(own[order], return_index=True, return_counts=True)
    return _packed(ids, of_own[order][first], length.astype(np.uint32), other[order], of_other[order], n[order])


@contextmanager
def _small_steps(spark: SparkSession) -> Iterator[None]:
    """Steps that run within it send few bytes to Python at once and give their shuffles back."""
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE), shuffles_dropped(spark):
        yield


def _most_frequent(counted: DataFrame, most: int) -> Column:
    """Holds for at most `most` words, those with the largest `of_word`, leaving out all words about as frequent as the first left out."""
    step = F.floor(F.log2(F.col("of_word").cast("double")) * 256).cast("int")
    steps = counted.filter("of_word > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, words_in = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        words_in += r["n"]
        if words_in > most:
            break
        least = r["step"]
    return (F.col("of_word") > 0) & (step >= least) if least is not None else F.lit(False)


def numbered_neighbours(df: DataFrame, column: str, window: int = 5, known: int | None = None) -> Neighbours:
    """Neighbours within `window` words by the words' numbers, which are hashes that no two of the words share.

    `known`: how many frequent words at most every task knows, `HEAD` unless told otherwise; the pairs do not depend on it.
    """
    spark = df.sparkSession
    listed = df.select(text_words(F.col(f"`{column}`")).alias("w")).filter(F.size("w") > 1)
    with _small_steps(spark):
        counted = written_table(_counted_words(listed, window), "words")
        turn = 0
        while not counted.groupBy(_number(F.col("word"), turn).alias("id")).count().filter("count > 1").isEmpty():
            turn += 1
        named = counted.select(_number(F.col("word"), turn).alias("id"), "word", "of_word")
        top = named.filter(_most_frequent(named, known or HEAD)).select("id", "of_word").toArrow()
        ids, of = (top.column(i).to_numpy() for i in (0, 1))
        order = np.lexsort([ids, -of])
        head = spark.sparkContext.broadcast(Head(ids[order], of[order]))
        parts = max(1, -(-(named.agg(F.sum("of_word")).first()[0] or 0) // (2 * PAIRS_PER_PART)))
        numbers = listed.select(F.transform("w", lambda w: _number(w, turn)).alias("w"))
        of_words = written_table(_word_blocks(named, head, parts, "of_word"), "word_blocks")
        met = written_table(_by_part(_merged(parts), numbers.mapInArrow(tidy(_met(window, head, parts, WORDS_PER_STRETCH)), BLOCKS).union(of_words)), "met")
        others = written_table(_by_part(_both_parts(parts), met.filter("kind = 3").union(of_words)), "others")
        drop_written(of_words)
    return Neighbours(named, met.filter("kind = 1").union(others), head, parts, [counted, met, others])


def neighbour_counts(df: DataFrame, column: str, window: int = 5) -> DataFrame:
    """`(word, context, n)`: how often the two words occur within `window` words of each other, in both directions.

    Pairs are counted once, by numbers of the words, before the other direction is added; a word
    next to itself counts twice.
    """
    found = numbered_neighbours(df, column, window)
    return _both_ways(found.named(found.pairs, "a", "b"))


def associations(counts: DataFrame | Neighbours, shift: float = 1.0, min_count: int = 1) -> DataFrame:
    """`(word, context, n, value)`, value = ln(n * total / (n of word * n of context)) - ln(shift), where positive.

    `min_count` leaves out words with fewer neighbours in all. Of numbered neighbours the words are
    their numbers, and a pair of which one is frequent is weighed once for both directions.
    """
    if isinstance(counts, Neighbours):
        head, weigh = counts.head, _weigher(counts, shift, min_count)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for kind, a, b, n, of_a, of_b in _pairs_in(batches, head.value):
                n = np.where(a == b, 2 * n, n)
                value = weigh(n, of_a, of_b)
                found = value > 0
                a, b, n, value = a[found], b[found], n[found], value[found]
                yield from _in_rows([a, b, n, value], ["word", "context", "n", "value"])
                if kind == 1:
                    back = a != b
                    yield from _in_rows([b[back], a[back], n[back], value[back]], ["word", "context", "n", "value"])

        return counts.blocks.mapInArrow(tidy(read), "word long, context long, n long, value double")
    cells = written_table(counts, "neighbours")
    totals = written_table(cells.groupBy("word").agg(F.sum("n").alias("of_word")), "totals").withColumnRenamed("word", "id")
    everything = totals.agg(F.sum("of_word")).first()[0] or 0
    kept = totals.filter(F.col("of_word") >= min_count)
    for side, of in (("word", "of_word"), ("context", "of_context")):
        cells = cells.join(kept.select(F.col("id").alias(side), F.col("of_word").alias(of)), side)
    chance = F.col("of_word").cast("double") * F.col("of_context").cast("double")
    value = F.log(F.col("n").cast("double") * F.lit(float(everything)) / chance) - math.log(shift)
    return cells.select("word", "context", "n", value.alias("value")).filter("value > 0")


def _weigher(counts: Neighbours, shift: float, min_count: int):
    """Of counts and the two words' neighbours the values; 0 where a word is left out."""
    everything = float(counts.words.agg(F.sum("of_word")).first()[0] or 0)

    def weigh(n: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
        value = np.log(n.astype(float) * everything / (of_a.astype(float) * of_b.astype(float))) - math.log(shift)
        return np.where((of_a >= min_count) & (of_b >= min_count), value, 0.0)

    return weigh


def _loaded(data: bytes, turn: np.ndarray | None, hashes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block and their numbers, a row for each direction: random signs, or the block's rows times `turn`."""
    ids, *rest = _unpacked(data)
    if turn is None:
        return ids, np.array([((rest[j // 64].view(np.uint64) >> np.uint64(j % 64)) & np.uint64(1)).astype(float) * 2 - 1 for j in range(width)]).reshape(width, len(ids))
    return ids, turn.T @ rest[0].reshape(len(turn), len(ids))


def _head_rows(rows: DataFrame, head: Head, load: Callable[[bytes], tuple], width: int) -> np.ndarray:
    """The numbers of the frequent words, a row for each direction; zeros where there are none."""
    out = np.zeros((width, len(head.ids)))
    for r in rows.filter("part < 0").select("data").collect():
        ranks, values = load(bytes(r[0]))
        out[:, ranks] = values
    return out


def _head_blocks(table: DataFrame, head: object, *more: str) -> DataFrame:
    """Blocks of the frequent words, by ranks; their parts are numbered from -1 down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            ranks = head.value.ranks(ids)
            some = np.flatnonzero(ranks >= 0)
            for part, at in _cut(ranks[some] // ROWS_TOGETHER):
                yield _block_rows([(-1 - part, 0, _packed(ranks[some[at]], *(x[some[at]] for x in rest)))])

    return table.select("id", *more).mapInArrow(run, BLOCKS)


def _multiplied(counts: Neighbours, weigh: Callable, load: Callable[[bytes], tuple], top: object, width: int):
    """Of a part's pairs and its words' numbers what they add to the product, for the part's own words, others and, at the end, frequent ones."""
    head, parts, state = counts.head, counts.parts, {}

    def run(part, held):
        q_top = top.value
        ids, q = np.empty(0, np.int64), np.empty((width, 0))
        if 0 in held:
            pieces = [load(x) for x in held[0]]
            ids, q = np.concatenate([x[0] for x in pieces]), np.concatenate([x[1] for x in pieces], axis=1)
            order = np.argsort(ids)
            ids, q = ids[order], q[:, order]
        if not state:
            state.update(sums=np.zeros((width, len(head.value.ids))), met=np.zeros(len(head.value.ids), bool))
        own, met = np.zeros((width, len(ids))), np.zeros(len(ids), bool)
        for data in held.get(1, []):
            rank, names, of, length, b, n = _cells_of(1, data, head.value)
            a = np.repeat(np.arange(len(names)), length)
            same = rank[a] == b
            value = weigh(np.where(same, 2 * n.astype(np.int64), n), of[a], head.value.of[b])
            keep = value > 0
            a, b, value, same = a[keep], b[keep], value[keep], same[keep]
            back = np.where(same, 0.0, value)
            tops = int((rank >= 0).sum())
            rows, some = np.searchsorted(ids, names[tops:]), np.flatnonzero(np.bincount(a, minlength=len(names)))
            met[rows[some[some >= tops] - tops]] = True
            state["met"][rank[some[some < tops]]] = state["met"][b] = True
            for j in range(width):
                column = np.concatenate([q_top[j][rank[:tops]], q[j][rows]])
                to = np.bincount(a, value * q_top[j][b], len(names))
                state["sums"][j][rank[:tops]] += to[:tops]
                own[j][rows] += to[tops:]
                state["sums"][j] += np.bincount(b, back * column[a], len(state["met"]))
        for data in held.get(2, []):
            names, of, length, other, of_other, n = _cells_of(2, data, head.value)
            a = np.repeat(np.arange(len(names)), length)
            same = names[a] == other
            value = weigh(np.where(same, 2 * n, n), of[a], of_other)
            keep = value > 0
            a, other, value = np.searchsorted(ids, names)[a[keep]], other[keep], value[keep]
            others, code = np.unique(other, return_inverse=True)
            sent = np.array([np.bincount(code, value * q[j][a], len(others)) for j in range(width)]).reshape(width, len(others))
            for to, at in _cut(_parts_of(others, parts)):
                yield to, 0, _packed(others[at], sent[:, at].ravel())
        if met.any():
            yield part, 0, _packed(ids[met], own[:, met].ravel())

    def last():
        for part, at in _cut(np.flatnonzero(state["met"]) // ROWS_TOGETHER if state else np.empty(0, np.int64)):
            ranks = np.flatnonzero(state["met"])[at]
            yield -1 - part, 0, _packed(ranks, state["sums"][:, ranks].ravel())

    return run, last


def _summed_rows(width: int):
    def run(part, held):
        pieces = [_unpacked(x) for x in held[0]]
        ids, code = np.unique(np.concatenate([x[0] for x in pieces]), return_inverse=True)
        sums = np.zeros((width, len(ids)))
        at = 0
        for own, values in pieces:
            sums[:, code[at:at + len(own)]] += values.reshape(width, len(own))
            at += len(own)
        yield part, 0, _packed(ids, sums.ravel())

    return run


def _times(counts: Neighbours, weigh: Callable, rows: DataFrame, load: Callable[[bytes], tuple], width: int) -> DataFrame:
    """Blocks of the table's product with one row of numbers per word, which `load` reads from blocks."""
    spark = counts.words.sparkSession
    top = spark.sparkContext.broadcast(_head_rows(rows, counts.head.value, load, width))
    # Each task adds up the frequent words' rows, so tasks are few: some parts for each, or one for each core.
    tasks = min(counts.parts, max(spark.sparkContext.defaultParallelism, counts.parts // 16))
    run, last = _multiplied(counts, weigh, load, top, width)
    added = _by_part(run, counts.blocks.union(rows.filter("part >= 0")), last, tasks)
    out = written_table(_by_part(_summed_rows(width), added), "factor")
    top.unpersist()
    return out


def _products(rows: DataFrame, left: int, right: int, pairs: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum over all words of the outer product of two rows of numbers, which `pairs` gives as columns of matrices."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((left, right))
        for batch in batches:
            for data in zip(*batch.columns):
                x, y = pairs([d.as_py() for d in data])
                total += x @ y.T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(left * right), pa.int64()), pa.array(total.ravel())], names=["cell", "v"])

    out = np.zeros(left * right)
    for r in rows.mapInArrow(add, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(left, right)


def _signed(columns: np.ndarray) -> np.ndarray:
    """Eigenvectors with their largest entry positive."""
    if not columns.size:
        return columns
    return columns * np.where(columns[np.abs(columns).argmax(axis=0), np.arange(columns.shape[1])] < 0, -1.0, 1.0)


def _orthonormal(rows: DataFrame, width: int) -> np.ndarray:
    """The matrix that turns the rows' columns into orthonormal ones that span the same space."""

    def both(data):
        values = _unpacked(data[0])[1].reshape(width, -1)
        return values, values

    sizes, basis = np.linalg.eigh(_products(rows.select("data"), width, width, both))
    real = sizes > NEGLIGIBLE * max(sizes.max(initial=0.0), 0.0)
    return _signed(basis[:, real]) / np.sqrt(sizes[real])


@dataclass
class WordVectors:
    """`table`: (word, vector) with `size` numbers each, and `of_word`, how many neighbours the word had; `values`: the eigenvalues behind them."""

    table: DataFrame
    size: int
    values: list[float]

    def save(self, path: str) -> None:
        self.table.select("*", F.array(*map(F.lit, self.values)).cast("array<double>").alias("values")).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, size: int) -> WordVectors:
        stored = spark.read.parquet(path)
        first = stored.select("values").first()
        return WordVectors(stored.drop("values"), size, list(first[0]) if first else [0.0] * size)


def fit_word_vectors(df: DataFrame, column: str, size: int = 50, window: int = 5, shift: float = 1.0, min_count: int = 1,
                     rounds: int = 3, seed: int = 42) -> WordVectors:
    """Vectors of `size` numbers for every word: leading eigenvectors times the roots of their eigenvalues."""
    width = size + EXTRA
    counts = numbered_neighbours(df, column, window, min(HEAD, max(1, HEAD_BYTES // (8 * width))))
    spark, weigh = df.sparkSession, _weigher(counts, shift, min_count)
    hashes = -(-width // 64)
    hashed = counts.words.select("id", *[F.xxhash64("word", F.lit(seed + i)).alias(f"h{i}") for i in range(hashes)])
    names = [f"h{i}" for i in range(hashes)]

    def loader(turn, width):
        return lambda data: _loaded(data, turn, hashes, width)

    with _small_steps(spark):
        start = _word_blocks(hashed, counts.head, counts.parts, *names).union(_head_blocks(hashed, counts.head, *names))
        y, before = _times(counts, weigh, start, loader(None, width), width), None
        for _ in range(rounds):
            turn = _orthonormal(y, width)
            width = turn.shape[1]
            if before is not None:
                drop_written(before)
            if not width:
                drop_written(y)
                counts.drop()
                return WordVectors(spark.createDataFrame([], "word string, vector array<double>"), size, [0.0] * size)
            load = loader(turn, width)
            before, y = y, _times(counts, weigh, y, load, width)

        def both(data):
            ids, q = load(data[0])
            own, values = _unpacked(data[1])
            return q[:, np.searchsorted(ids, own)], values.reshape(width, len(own))

        # The table seen from the last directions is a small symmetric matrix.
        pairs = before.select("part", F.col("data").alias("q")).join(y.select("part", "data"), "part").select("q", "data")
        small = _products(pairs, width, width, both)
        values, basis = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-np.abs(values), kind="stable")[:size]
        turn = np.zeros((width, size))
        turn[:, :len(best)] = _signed(basis[:, best]) * np.sqrt(np.abs(values[best]))
        head = counts.head

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                    ids, q = load(data.as_py())
                    ids = head.value.ids[ids] if part < 0 else ids
                    vector = np.ascontiguousarray(q.T @ turn).ravel()
                    for at in range(0, len(ids), 10_000):
                        n = min(10_000, len(ids) - at)
                        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * size)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at:at + n]), pa.ListArray.from_arrays(offsets, pa.array(vector[at * size:(at + n) * size]))],
                                                         names=["word", "vector"])

        found = before.mapInArrow(vectors, "word long, vector array<double>").withColumnRenamed("word", "id")
        table = written_table(found.join(counts.words, "id").select("word", "vector", "of_word"), "word_vectors")
        drop_written(before, y)
        counts.drop()
    return WordVectors(table, size, [*map(float, values[best]), *[0.0] * (size - len(best))])


def document_vectors(df: DataFrame, column: str, vectors: WordVectors, drop_original: bool = True, prefix: str = "w2v_dim_") -> DataFrame:
    """Adds `w2v_dim_i`: the mean of the text's word vectors. Equal texts are averaged once.

    Vectors of frequent words go to every task; only a text's other words are sent to meet theirs.
    """
    key = F.unhex(F.md5(F.coalesce(F.col(f"`{column}`"), F.lit(""))))
    # Copies of a text multiply all its counts alike, which leaves the mean.
    # The key is made before the words are, not again for each of them.
    listed = df.select(key.alias("_text"), text_words(F.col(f"`{column}`")).alias("_words")).select("_text", F.explode("_words").alias("word"))
    # Vectors that were saved without counts all go the way of the other words.
    often = _most_frequent(vectors.table, COMMON_BYTES // (8 * max(vectors.size, 1))) if "of_word" in vectors.table.columns else F.lit(False)
    frequent = vectors.table.filter(often).select("word", F.col("vector").alias("_known"))
    names = [f"{prefix}{i}" for i in range(vectors.size)]
    # No word holds a space, so the key of a text's frequent words meets no word.
    other = F.when(F.col("_known").isNull(), F.col("word"))
    counted = listed.join(F.broadcast(frequent), "word", "left").groupBy("_text", other.alias("_other")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_known")[i]).alias(n) for i, n in enumerate(names)])
    counted = counted.withColumn("word", F.coalesce("_other", F.concat(F.lit(" "), F.hex("_text"))))
    found = counted.join(vectors.table.select("word", "vector"), "word", "left")
    means = found.groupBy("_text").agg(*[
        (F.coalesce(F.sum(F.coalesce(F.col(n), F.col("n") * F.col("vector")[i])), F.lit(0.0)) / F.sum("n")).alias(n) for i, n in enumerate(names)])
    kept = [c for c in df.columns if not (drop_original and c == column)]
    wide = df.withColumn("_text", key).join(means, "_text", "left")
    return wide.select(*[F.col(f"`{c}`") for c in kept], *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def nearest_words(vectors: WordVectors, word: str, k: int = 10) -> DataFrame:
    """The `k` words with the largest cosine to the given one; the smaller word first on a tie."""
    target = vectors.table.filter(F.col("word") == word).select("vector").first()
    if target is None:
        return vectors.table.select("word", F.lit(0.0).alias("cosine")).limit(0)
    aim = np.array(target["vector"])
    aim = aim / (np.linalg.norm(aim) or 1.0)
    dot = sum((F.col("vector")[i] * float(a) for i, a in enumerate(aim)), F.lit(0.0))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    cosine = F.when(length > 0, dot / length).otherwise(0.0)
    return vectors.table.filter(F.col("word") != word).select("word", cosine.alias("cosine")).orderBy(F.desc("cosine"), "word").limit(k)
