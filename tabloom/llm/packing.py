"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. The rounds are windows of about
`window` sequences. In every round a source earns a quantum of tokens, its share of the
target mixture, sends the whole tokens it has earned and carries the rest, less than one
token, to the next round; documents are cut freely. A source's quantum is the fraction
tokens / rounds, so what it has sent after w rounds is ceil(w * tokens / rounds): every
window of every source is known without simulating the ones before it, and deficits carry
across windows and partitions alike. Windows follow each other without gaps and are cut into
sequences, so only the last sequence has padding.

Without a mixture each source's share is its share of all tokens, so all end together. With
one, a source whose tokens run out drops out and the others keep their proportions. A source
without a weight in the mixture is an error, since its rows would be lost.

Edge cases: null and empty texts are one end token; a null source is a queue of its own; rows
repeated in full are packed each for itself; documents longer than a sequence run on in the
next ones; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import written_table

from .common import running_start, small_batches, tidy

END = 2
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_SPLIT_TOO_MUCH = re.compile("[\x1c-\x1f]")
#: Marks that letters may join into one sign before they are lower-cased.
_COMBINING = re.compile("[\u0300-\u036f]")
#: ASCII marks that end a run of letters; not the apostrophe, which begins contractions.
_MARKS = string.punctuation.replace("'", "")
#: A run of marks behind a letter or digit and before white space is a unit of the tokenizer.
_END_MARKS = re.compile(rf"[{re.escape(_MARKS)}](?<=[a-z0-9].)[{re.escape(_MARKS)}]*(?=[ \n])")
_LATIN = re.compile("[a-z\x80-\u024f]+")


def _byte_signs() -> np.ndarray:
    """The code points by which byte-level models write letters' bytes; ASCII and the space between words stay."""
    signs, more = np.arange(256, dtype="<u4"), 256 + 33
    for b in range(127, 256):
        if b < 161 or b == 173:
            signs[b], more = more, more + 1
    return signs


_BYTE_SIGNS = _byte_signs()


class WordEncoder:
    """Token ids of a text, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins across it, so each different word is
    encoded once and remembered. At `most` new words the memory starts anew, and only words
    of the former one that occur again move over, so at most twice as many words are held.
    A run of Latin letters is one unit of the tokenizer in lower case, so all new ones go to a
    copy of it as one line in the model's own signs, which skips normalising and cutting; the
    last token of a word is marked as such in the vocabulary, so their ids are told apart.
    """

    def __init__(self, path: str | None = None, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.former: dict[str, bytes] = {}
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = WhitespaceSplit()
        last = [i for t, i in self.letters.get_vocab().items() if t.endswith(self.letters.model.end_of_word_suffix or "\n")]
        self.is_last = np.zeros(max(self.letters.get_vocab().values()) + 1, dtype=bool)
        self.is_last[last] = True

    @staticmethod
    def words(text: str | None) -> list[str]:
        if not text:
            return []
        return [w for w in _SPACES.split(text) if w] if _SPLIT_TOO_MUCH.search(text) else text.split()

    @classmethod
    def units(cls, text: str | None) -> list[str]:
        """Words in lower case (of ASCII letters) with the marks behind them cut off, which leaves the ids but fewer different words."""
        # Special tokens are found in the text as it is written.
        if text and "<|" not in text:
            if text.isascii():
                text = text.lower()
            elif not _COMBINING.search(text):
                text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            text = _END_MARKS.sub(r" \g<0>", text)
        return cls.words(text)

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text; the new words of all of them are encoded together."""
        cut = [self.units(t) for t in texts]
        if len(self.known) > self.most:
            self.known, self.former = {}, self.known
        known, former = self.known, self.former
        missing = set(filterfalse(known.__contains__, chain.from_iterable(cut)))
        if former:
            again = [w for w in missing if w in former]
            known.update((w, former.pop(w)) for w in again)
            missing.difference_update(again)
        if missing:
            self._learn(missing)
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def _learn(self, missing: set[str]) -> None:
        """Adds words to the memory; letters followed by marks are encoded as letters and marks, each once."""
        known, whole = self.known, []
        plain = [w for w in missing if w.isascii() and w.isalpha() and w.islower()]
        words, cores, ends = [], [], []
        for w in missing.difference(plain):
            core = w.rstrip(_MARKS)
            low = core.lower()
            if low.isalpha() and _LATIN.fullmatch(low):
                words.append(w)
                cores.append(low)
                ends.append(w[len(core):])
            else:
                whole.append(w)
        self._remember(self.tokenizer, [*whole, *(m for m in set(ends) if m and m not in known)])
        self._remember_letters(plain)
        self._remember_letters([w for w in set(cores) if w not in known])
        for w, low, marks in zip(words, cores, ends):
            known[w] = known[low] + known[marks] if marks else known[low]

    def _remember_letters(self, words: list[str]) -> None:
        """Adds lower-case words of letters only."""
        line = " ".join(words)
        if not line.isascii():
            line = _BYTE_SIGNS[np.frombuffer(line.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.letters.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.is_last[ids]) + 1
        if len(ends) != len(words) or len(ids) and ends[-1] != len(ids):
            self._remember(self.tokenizer, words)  # a vocabulary that does not mark the last tokens
            return
        data, at, known = ids.tobytes(), 0, self.known
        for w, end in zip(words, (ends * 4).tolist()):
            known[w] = data[at:end]
            at = end

    def _remember(self, tokenizer, words: list[str]) -> None:
        known = self.known
        for w, e in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    @property
    def stored(self) -> str:
        """The number type that stores an id: two bytes are enough for most vocabularies."""
        return "<u2" if max(self.tokenizer.get_vocab_size(), END + 1) <= 1 << 16 else "<u4"


@lru_cache(maxsize=1)
def word_encoder(path: str | None) -> WordEncoder:
    """One for each worker process, so that tasks that follow each other share its words."""
    return WordEncoder(path)


def tokenized(docs: DataFrame, path: str | None, key: str, text: str, source: str, texts_at_once: int = 256) -> DataFrame:
    """(doc, source, h, tokens, width, ids) for every row, written to the shared folder.

    h is a hash of the text; ids are the document's ids with the end token, `width` bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        kind, end = np.dtype(encoder.stored), END.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                ids = [np.frombuffer(x + end, "<u4") for x in encoder.encode_all(part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([len(x) for x in ids], pa.int64()), pa.array([kind.itemsize] * len(ids), pa.int32()),
                     pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], names=["doc", "source", "h", "tokens", "width", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    with small_batches(docs.sparkSession):
        return written_table(rows.mapInArrow(tidy(run), "doc long, source string, h long, tokens long, width int, ids binary"), "tokens")


def quanta(counts: DataFrame, window_tokens: int, mixture: dict[str | None, float] | None) -> DataFrame:
    """(source, total, rounds): a source earns total / rounds tokens in each of its rounds."""
    totals = counts.groupBy("source").agg(F.sum("tokens").alias("total"))
    if mixture is None:
        everything = totals.agg(F.sum("total")).first()[0] or 0
        return totals.withColumn("rounds", F.lit(max(1, -(-everything // window_tokens))))
    weight = sum(mixture.values())
    share = F.lit(None).cast("double")
    for name, part in mixture.items():
        share = F.when(F.col("source").eqNullSafe(F.lit(name)), part / weight).otherwise(share)
    checked = F.when(share > 0, share).otherwise(F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("source", F.lit("null")))))
    return totals.withColumn("rounds", F.greatest(F.lit(1), F.ceil(F.col("total") / (checked * window_tokens))))


def windows(sources: DataFrame) -> DataFrame:
    """(source, w, sent, until, place): source's tokens before and after window w, and where its run starts among all tokens."""
    last = sources.agg(F.max("rounds")).first()[0] or 0
    grid = sources.withColumn(
        "high", F.explode(F.sequence(F.lit(0), F.lit(max(0, last - 1) // 4096)))).withColumn(
        "w", F.explode(F.sequence(F.col("high") * 4096, F.least(F.col("high") * 4096 + 4095, F.lit(max(0, last - 1)))))).drop("high")
    at = "cast((cast(least({w}, rounds) as decimal(18,0)) * cast(total as decimal(19,0)) + rounds - 1) div rounds as bigint)"
    grid = grid.select("source", F.col("w").cast("long").alias("w"), F.expr(at.format(w="w")).alias("sent"), F.expr(at.format(w="w + 1")).alias("until"))
    window = Window.partitionBy("w")
    before = window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return grid.withColumn("place", F.sum("sent").over(window) + F.coalesce(F.sum(F.col("until") - F.col("sent")).over(before), F.lit(0)))


def layout(counts: DataFrame, length: int, window: int, mixture: dict[str | None, float] | None) -> DataFrame:
    """(doc, h, start, length, sequence_id, offset) of every piece."""
    sources = written_table(quanta(counts, length * window, mixture), "sources")
    queued = running_start(counts, ["source"], ["doc", "h"], F.col("tokens"), "p")
    totals = sources.select(F.col("source").alias("s"), "total", "rounds")
    queued = queued.join(totals, F.col("source").eqNullSafe(F.col("s")))
    number = "cast((cast({p} as decimal(19,0)) * cast(rounds as decimal(18,0))) div total as bigint)"
    split = queued.withColumn("w", F.explode(F.sequence(F.expr(number.format(p="p")), F.expr(number.format(p="(p + tokens - 1)")))))
    runs = windows(sources).select(F.col("source").alias("s2"), F.col("w").alias("w2"), "sent", "until", "place")
    split = split.join(runs, (F.col("w") == F.col("w2")) & F.col("source").eqNullSafe(F.col("s2")))
    split = split.withColumn("a", F.greatest("p", "sent")).withColumn("b", F.least(F.col("p") + F.col("tokens"), "until")).filter("a < b")
    split = split.withColumn("g", F.col("place") + F.col("a") - F.col("sent")).withColumn("size", F.col("b") - F.col("a"))
    cut = split.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"g div {length}"), F.expr(f"(g + size - 1) div {length}"))))
    cut = cut.withColumn("from", F.greatest("g", F.col("sequence_id") * length))
    until = F.least(F.col("g") + F.col("size"), (F.col("sequence_id") + 1) * length)
    return cut.select("doc", "h", (F.col("a") - F.col("p") + F.col("from") - F.col("g")).alias("start"), (until - F.col("from")).alias("length"),
                      "sequence_id", (F.col("from") - F.col("sequence_id") * length).alias("offset"))


def _pieces(with_ids: bool):
    """Rows sorted by (doc, h, role): the places of a document's pieces, then its ids (again for repeated rows)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, current = [], None
        for batch in batches:
            out = []
            doc, h, role, width = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            offsets, fields = batch.column(3).offsets.to_pylist(), batch.column(3).values
            starts, lengths, sequences, at = (fields.field(name).to_pylist() for name in ("start", "length", "sequence_id", "offset"))
            for i in range(batch.num_rows):
                if role[i] == 0:
                    of = slice(offsets[i], offsets[i + 1])
                    current, places = (doc[i], h[i]), [*zip(starts[of], lengths[of], sequences[of], at[of])]
                    continue
                assert current == (doc[i], h[i])
                if places:
                    ids = np.frombuffer(batch.column(5)[i].as_buffer(), f"<u{width[i]}").astype("<u4")
                    for start, length, sequence, offset in places:
                        piece = ids[start:start + length]
                        out.append((doc[i], start, length, zlib.crc32(piece), len(ids), sequence, offset, piece.astype(np.int32) if with_ids else None))
                places = []
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array([o[i] for o in out], pa.int64()) for i in range(7)]
            if with_ids:
                arrays.append(pa.array([o[7] for o in out], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

    return cut


def pack(docs: DataFrame, length: int = 4096, window: int = 64, mixture: dict[str | None, float] | None = None, path: str | None = None,
         with_ids: bool = False, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Texts are tokenized once; their written ids are brought to their pieces by one shuffle.
    """
    tokens = tokenized(docs, path, key, text, source)
    counts = tokens.select("doc", "source", "h", "tokens")
    parts = layout(counts, length, window, mixture).groupBy("doc", "h").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    kind = parts.schema["pieces"].dataType
    stored = tokens.select("doc", "h", F.lit(1).alias("role"), F.lit(None).cast(kind).alias("pieces"), "width", "ids")
    rows = parts.select("doc", "h", F.lit(0).alias("role"), "pieces", F.lit(None).cast("int").alias("width"), F.lit(None).cast("binary").alias("ids")).union(stored)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return rows.repartition("doc", "h").sortWithinPartitions("doc", "h", "role").mapInArrow(tidy(_pieces(with_ids), word_encoder.cache_clear), schema)
