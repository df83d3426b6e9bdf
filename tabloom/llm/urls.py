"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

A URL is lower-cased (A-Z) and searched once for all terms. A hit counts if the characters
beside it are not letters or digits. One strict term, or `soft_needed` different soft terms,
reject the URL; `url_weight` is the summed weight of the different terms found.

Edge cases: a null URL, or one without `://`, has an empty host and path, fits no rule and is
judged by its vocabulary (null: allowed, weight 0); empty tables give empty results; repeated
rows are judged each for itself; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the query: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
STRICT = {"porn": 1.0, "porno": 1.0, "xxx": 1.0, "hentai": 1.0, "camgirls": 1.0, "sexcam": 1.0, "escorts": 1.0,
          "onlinecasino": 1.0, "warez": 1.0, "keygen": 1.0, "darkweb-market": 1.0, "torrent-download": 1.0}
SOFT = {"adult": 0.5, "sex": 0.6, "nude": 0.6, "erotic": 0.6, "casino": 0.5, "poker": 0.4, "betting": 0.4, "jackpot": 0.4,
        "viagra": 0.6, "pills": 0.3, "payday": 0.4, "loans": 0.3, "crack": 0.4, "torrent": 0.4, "replica": 0.3,
        "free-download": 0.3, "click": 0.2, "track": 0.2, "utm_source": 0.2, "ref": 0.1, "feed": 0.1}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (lower case) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    end = min(ends, default=len(rest))
    ends = [i for i in (rest.find(c, end) for c in "?#") if i >= 0]
    return rest[:end].translate(LOWER), rest[end:min(ends, default=len(rest))]


def rule_index(rules) -> dict[str, list[tuple[str, str]]]:
    index: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        index.setdefault(host, []).append((path, verdict))
    return index


def best_rule(host: str, path: str, index) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict. Each suffix of the host is looked up once."""
    best, verdict, suffix = None, None, host
    while True:
        for start, says in index.get(suffix, ()):
            if path.startswith(start) and (best is None or len(suffix + start) > len(best)):
                best, verdict = suffix + start, says
        _, dot, suffix = suffix.partition(".")
        if not dot:
            return best, verdict


def automaton(terms):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def terms_in(url: str, machine) -> set[str]:
    """Different terms of the vocabulary that stand between boundaries."""
    text, hits = url.translate(LOWER), set()
    for end, term in machine.iter(text):
        start = end - len(term)
        if (start < 0 or text[start] not in WORD) and (end + 1 == len(text) or text[end + 1] not in WORD):
            hits.add(term)
    return hits


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = 2, key: str = "page_id", url: str = "url") -> DataFrame:
    """Key, host, path, rule, verdict, url_weight, strict_hits, soft_hits for every row; row-wise, no shuffle."""
    index, key_type = rule_index(rules), pages.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton([*strict, *soft])
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                host, path = split_url(value)
                rule, verdict = best_rule(host, path, index)
                hits = terms_in(value, machine) if value else set()
                n_strict = sum(t in strict for t in hits)
                n_soft = len(hits) - n_strict
                weight = round(sum(sorted(strict.get(t, soft.get(t)) for t in hits)), 6)
                out.append((host, path, rule, verdict or ("block" if n_strict or n_soft >= soft_needed else "allow"), float(weight), n_strict, n_soft))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.float64(), pa.int64(), pa.int64()]
            names = ["host", "path", "rule", "verdict", "url_weight", "strict_hits", "soft_hits"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[key, *names])

    schema = f"`{key}` {key_type}, host string, path string, rule string, verdict string, url_weight double, strict_hits long, soft_hits long"
    return pages.select(key, url).mapInArrow(judge, schema)


def url_sql(rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = 2) -> str:
    """The same judgement for DuckDB, from regular expressions."""
    import re

    def hit(term):
        return f"regexp_matches(low, '(^|[^a-z0-9]){re.escape(term)}([^a-z0-9]|$)')::BIGINT"

    def total(terms):
        return " + ".join(hit(t) for t in terms)

    fits = [(len(h + p), f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'") for _, h, p in rules]
    rule = "CASE " + " ".join(x for _, x in sorted(fits, reverse=True)) + " END"
    says = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in rules) + " END"
    weight = " + ".join(f"{w} * {hit(t)}" for t, w in {**strict, **soft}.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH u AS (SELECT page_id, coalesce(translate(url, '{upper}', '{lower}'), '') AS low,
                      CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
    p AS (SELECT page_id, low, translate(raw, '{upper}', '{lower}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    r AS (SELECT *, {rule} AS rule, {total(strict)} AS strict_hits, {total(soft)} AS soft_hits, round({weight}, 6)::DOUBLE AS url_weight FROM p)
    SELECT page_id, host, path, rule, coalesce({says}, CASE WHEN strict_hits > 0 OR soft_hits >= {soft_needed} THEN 'block' ELSE 'allow' END) AS verdict,
           url_weight, strict_hits, soft_hits FROM r"""
