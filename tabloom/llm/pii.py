"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

Base kinds (email, ip, card, phone) are found by fixed patterns and checks and always stay.
Further kinds are kept if their score reaches `keep`: an account number (`iban`) whose mod-97
check holds, and an identity number (`id_number`) that looks right and has a fitting word
nearby. Positions count code points; ends are exclusive.

Edge cases: null and empty texts have no spans (and stay as they are when redacted); texts of
any length are read whole, in time linear in their length; rows with equal text or id are
handled each for itself; an empty table gives an empty result; further columns are kept by
`redact` and ignored by `find_pii`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

KINDS = ["email", "ip", "card", "phone", "iban", "id_number"]
BASE = KINDS[:4]
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole: no part of it can start a match that the run itself cannot.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Lengths of account numbers by country; another length is tried after it, for countries not listed and numbers made up.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23,
    "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20}
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
#: Score of a span without context, and of the words that raise or lower it within `reach` characters.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "id_number": 0.3}
RAISE = {"email": ("email", "e-mail", "mail", "contact"), "ip": ("ip", "address", "server", "host"),
         "card": ("card", "visa", "credit", "debit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
         "iban": ("iban", "account", "bank", "transfer"), "id_number": ("ssn", "social", "security", "identity", "passport")}
LOWER = ("example", "version", "sample", "test", "order", "isbn")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Matches in order. A local part is the run before an `@`, so each `@` is tried once."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and not _NOT_LOCAL.match(text, start - 1):
                start -= 1
        if domain and start < at:
            spans.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return found
    for m in _IP.finditer(text):
        if all(int(part[-400:]) <= 255 and len(part.lstrip("0")) <= 3 for part in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """Matches in order. A match may have taken words in capitals that follow, so it may end before each of its spaces:
    where the country's length says, or else as late as the check allows. Without an end, its other words are tried."""
    spans, m = [], _IBAN.search(text)
    while m:
        at, ends = m.start(), []
        for end in [m.end(), *(i for i in range(m.end() - 1, m.start(), -1) if text[i] == " ")]:
            account = text[at:end].replace(" ", "")
            if 15 <= len(account) <= 34 and mod97(account):
                ends.append((len(account) != IBAN_LENGTH.get(account[:2]), -end))
        if ends:
            spans.append((at, -min(ends)[1]))
        m = _IBAN.search(text, spans[-1][1] if ends else at + 1)
    return spans


def further_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if _DIGITS.search(text):
        found += [("iban", a, b) for a, b in ibans(text)]
        for m in _ID.finditer(text):
            area, group, serial = m[0].split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                found.append(("id_number", m.start(), m.end()))
    return found


def score(text: str, kind: str, start: int, end: int, reach: int = 40) -> float:
    """Start score, plus 0.3 with a fitting word nearby, less 0.2 with a doubtful one, within 0 to 1."""
    near = set(re.findall(r"[a-z-]+", (text[max(0, start - reach):start] + " " + text[end:end + reach]).lower()))
    return min(1.0, max(0.0, START[kind] + 0.3 * (not near.isdisjoint(RAISE[kind])) - 0.2 * (not near.isdisjoint(LOWER))))


def spans_of(text: str | None, keep: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans, by kind as listed, then start."""
    if not text:
        return []
    scored = [(k, a, b, score(text, k, a, b)) for k, a, b in base_spans(text)]
    return scored + [x for x in ((k, a, b, score(text, k, a, b)) for k, a, b in further_spans(text)) if x[3] >= keep]


def digest(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: float = 0.5) -> DataFrame:
    """Key, spans (array of kind, start, end, score), base_sha256, spans_text; row-wise, no shuffle."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans = [spans_of(t.as_py(), keep) for t in batch.column(1)]
            base = [hashlib.sha256(digest(x for x in s if x[0] in BASE).encode()).hexdigest() for s in all_spans]
            shown = [[dict(zip(("kind", "start", "end", "score"), x)) for x in s] for s in all_spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, _SPANS), pa.array(base, pa.string()),
                                              pa.array([digest(s) for s in all_spans], pa.string())], names=[key, "spans", "base_sha256", "spans_text"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, spans array<struct<kind: string, start: long, `end`: long, score: double>>, base_sha256 string, spans_text string"
    return docs.select(key, text).mapInArrow(tidy(find), schema)


def masked(text: str | None, keep: float = 0.5) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the first span's kind in brackets."""
    if not text:
        return text
    parts, done = [], 0
    for kind, start, end, _ in sorted(spans_of(text, keep), key=lambda x: (x[1], -x[2])):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def redact(docs: DataFrame, text: str = "text", keep: float = 0.5) -> DataFrame:
    """All rows and columns, with personal data in `text` masked."""
    place = docs.columns.index(text)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(place, text, pa.array([masked(t.as_py(), keep) for t in batch.column(place)], pa.string()))

    return docs.mapInArrow(tidy(mask), docs.schema)


def counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The operator's result with a count for each base kind."""
    kinds = F.col("spans.kind")
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(key, *n, "base_sha256", F.col("spans_text").alias("spans"))
