"""SentencePiece encoding and decoding over a trie of distinct marked words.

A text is marked (spaces become U+2581, one is put in front) and cut into marked words, and for a BPE model further where no piece
lies across: between an ASCII letter and a sign that follows no letter in any piece, and around
signs that no longer piece holds, such as a line break. No merge crosses such a place, so the ids
stay, and there are fewer distinct words. The distinct words of a batch are sorted, which walks their trie depth-first: each word shares the
forward states of its common prefix with the word before, and only the rest is computed.

The forward state of a prefix is the last piece of its best segmentation. The installed model
is of the BPE kind, whose segmentation is not the one with the largest sum of scores: merges
go by score, and a sequence of pieces is the right one exactly if each piece, and each pair of
neighbours, encodes to itself. So a state is reached from the state before the last piece if
the two pieces are such neighbours, and one last piece fits each prefix. For a unigram model
the states are the usual best sums.

Edge cases: null and empty texts have no ids, and no ids decode to the empty text; characters
without a piece become bytes; texts and words of any length are read whole in linear time;
U+2581 in a text decodes to a space, as in the library; equal texts have equal ids; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Model:
    def __init__(self, path: str | None = None, unigram: bool = False):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unigram, self.ids, self.scores, self.bytes_of = unigram, {}, {}, []
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                if MARK in piece.lstrip(MARK):
                    raise ValueError("this model has pieces that go beyond a marked word")
        self.longest = max(map(len, self.ids), default=1)
        # Lengths of the pieces that end in up to three given characters, longest first; a single character always counts.
        sizes: dict[str, set[int]] = {}
        for piece in self.ids:
            sizes.setdefault(piece[-3:], {1}).add(len(piece))
        for end in [e for e in sizes if len(e) == 3]:
            if end[1:] in self.ids:
                sizes[end].add(2)
        self.sizes = {end: tuple(sorted(n, reverse=True)) for end, n in sizes.items()}
        self.packed = {piece: i.to_bytes(4, "little") for piece, i in self.ids.items()}
        # For each piece: which pieces it may follow, as far as asked.
        self.fits: dict[str, dict[str, bool]] = {piece: {} for piece in self.ids}
        self.n_fits = 0
        self.lowest = min(self.scores.values(), default=0.0) - 10.0
        self.words = _WORDS if unigram else self._cut_words()

    def _cut_words(self) -> re.Pattern:
        """Marked words, cut where no piece lies across."""
        signs = set(string.punctuation + "\t\n\r")
        alone = signs.difference(*(p for p in self.ids if len(p) > 1))
        behind = signs.difference(*(re.findall("(?<=[A-Za-z])[^A-Za-z]", p) for p in self.ids))
        one, no_letters = (re.escape("".join(sorted(x))) for x in (alone, behind))
        cuts = [f"[A-Za-z]++(?=[{no_letters}])"] * bool(behind) + [f"[{one}]"] * bool(alone) + [f"[^{MARK}{one}]+"]
        return re.compile(f"{MARK}*+(?:{'|'.join(cuts)})|{MARK}+")

    def merged(self, symbols: list[str]) -> list[str]:
        """Segmentation of a short string by its merges: highest score first, leftmost among equals."""
        symbols, score, none = list(symbols), self.scores.get, -np.inf
        pairs = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            i = pairs.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(symbols[i - 1] + symbols[i], none)
            if i < len(pairs):
                pairs[i] = score(symbols[i] + symbols[i + 1], none)
        return symbols

    def neighbours(self, a: str, b: str) -> bool:
        """Whether the pieces a, b are the segmentation of their concatenation ('' stands for the start)."""
        before = self.fits.get(b)
        if before is None:
            before = self.fits[b] = {}
        known = before.get(a)
        if known is None:
            # A piece that its own merges do not reach has no neighbours.
            known = (not a or self.neighbours("", b)) and self.merged(list(a + b)) == [x for x in (a, b) if x]
            if self.n_fits > 400_000:
                self.n_fits = 0
                for each in self.fits.values():
                    each.clear()
            before[a] = known
            self.n_fits += 1
        return known

    def forward(self, word: str, states: list, start: int) -> None:
        """Extends states (one for each prefix, the empty one first) from prefix length `start` to the whole word.

        A state is the last piece, and for unigram models a pair of it and the sum of scores.
        """
        if self.unigram:
            self._forward_sums(word, states, start)
            return
        fits, sizes, single = self.fits.get, self.sizes.get, (1,)
        for end in range(start + 1, len(word) + 1):
            for size in sizes(word[end - 3 if end > 3 else 0:end]) or sizes(word[end - 2 if end > 2 else 0:end], single):
                if size > end:
                    continue
                piece = word[end - size:end]
                before = fits(piece)
                if before is None:
                    if size > 1:
                        continue
                    before = {}
                last = states[end - size]
                fit = before.get(last)
                if fit or fit is None and self.neighbours(last, piece):
                    states.append(piece)
                    break
            else:
                raise ValueError(f"no segmentation of {word[:end]!r}")

    def _forward_sums(self, word: str, states: list, start: int) -> None:
        for end in range(start + 1, len(word) + 1):
            found = None
            for size in self.sizes.get(word[max(0, end - 3):end]) or self.sizes.get(word[max(0, end - 2):end], (1,)):
                piece = word[end - size:end]
                if size > end or size > 1 and piece not in self.ids:
                    continue
                total = states[end - size][1] + self.scores.get(piece, self.lowest)
                if found is None or total > found[1]:
                    found = (piece, total)
            states.append(found)

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of each distinct word."""
        out, states, previous = {}, [("", 0.0) if self.unigram else ""], ""
        packed, unigram = self.packed.get, self.unigram
        for word in sorted(set(words)):
            shared = 0
            for x, y in zip(previous, word):
                if x != y:
                    break
                shared += 1
            del states[shared + 1:]
            self.forward(word, states, shared)
            piece = states[-1][0] if unigram else states[-1]
            end = len(word) - len(piece)
            ids = packed(piece) or self.as_bytes(piece)
            while end:
                piece = states[end][0] if unigram else states[end]
                ids = (packed(piece) or self.as_bytes(piece)) + ids
                end -= len(piece)
            out[word] = ids
            previous = word
        return out

    def as_bytes(self, piece: str) -> bytes:
        """Ids of the bytes of a character without a piece."""
        return b"".join(self.byte_ids[x].to_bytes(4, "little") for x in piece.encode("utf-8", "surrogatepass"))


class TextEncoder:
    """Encodes batches of texts; remembers a bounded number of words.

    At `most` words the memory starts anew, and words of the former one move over when they occur
    again, so frequent words are kept and at most about twice as many words are held.
    """

    def __init__(self, model: Model, most: int = 160_000):
        self.model, self.most, self.known, self.former = model, most, {}, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words_of = self.model.words.findall
        cut = [words_of(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > self.most:
            self.known, self.former = {}, self.known
        known, former = self.known, self.former
        missing = set().union(*cut).difference(known)
        if former:
            again = missing.intersection(former)
            known.update((w, former.pop(w)) for w in again)
            missing -= again
        if missing:
            known.update(self.model.encode_words(missing))
        return [b"".join(map(known.__getitem__, words)) for words in cut]


@lru_cache(maxsize=1)
def text_encoder(path: str | None) -> TextEncoder:
    """One for each worker process, so that tasks that follow each other share its words."""
    return TextEncoder(Model(path))


def decoded(model: Model, ids: Iterable[int]) -> str:
    text = b"".join(map(model.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", texts_at_once: int = 256) -> DataFrame:
    """Key and ids (array of int) for every row; row-wise, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """All rows and columns of `encoded`, and the text of its ids as `decoded`; null ids give the empty text."""
    place = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = text_encoder(path).model
        for batch in batches:
            texts = [decoded(model, x.values.to_numpy().tolist() if x.is_valid else ()) for x in batch.column(place)]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, schema + ", decoded string")
