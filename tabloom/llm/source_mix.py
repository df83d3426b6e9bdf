"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in hashed order, repeated as often as the cap
allows. A queue's packets (a document, or a piece of it of `quantum` words at most) get a
virtual finish time: words of the source up to the packet's end, divided by the source's
weight. All packets, sorted by that time, are the mix; it is cut where the total budget is
spent. Sources that run out stop sending and the others share what is left by weight, so
the targets, computed in closed form by filling up the sources, are what the cut yields.

The sort is by ranges: packets are dealt to ranges of finish time, the words of whole
ranges are summed, and only the range in which the budget runs out is put in order. What a
source sends before the cut is then one number, from which every document's share follows;
`mixed` returns the texts of the mix in the order of the finish times.

`quantum` is the words of the table divided by `resolution`, at least 1: it bounds the
packets by two per document and `2 * resolution` more. A source misses its target by a few
quanta at most, or by about one document where documents are smaller than that.

Edge cases: null texts have no words, and documents without words are never taken; a null
source is a source of its own, after all others; null and repeated ids are documents of
their own (ties of the order follow the text's MD5, then a hash of the row); an empty
table, or one without words, has targets of 0; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ordered import range_chunks, row_position, running_sums
from tabloom.session import written_table

from .common import spread_join

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEATS = 1.5, 2
RESOLUTION = 200_000
#: Packets that one task puts in order.
RANGE_ROWS = 100_000


@dataclass(frozen=True)
class Mix:
    """`placed`: doc_id, source, size, text_md5, start (words of the source before it); `sources`: source, rank, weight,
    source_size, target, served (words it sends); `quantum`: words in a packet."""

    placed: DataFrame
    sources: DataFrame
    quantum: int


def _weights(placed: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Written table (source, rank, weight, source_size): sources by code point, null last, take the weights in turn."""
    sums = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = row_position(sums, ["source"], name="rank")
    given = F.array(*[F.lit(float(w)) for w in weights])
    return written_table(ranked.withColumn("weight", F.get(given, (F.col("rank") % len(weights)).cast("int"))), "sources")


def targets(sources: DataFrame, budget: float, repeats: int = REPEATS) -> DataFrame:
    """Adds `target`: the budget by weight, never above `repeats` times the source, the excess shared anew.

    Sources fill up in the order of size / weight. The first one whose share, once all
    before it are full, does not exceed its cap gives the level of all that are not full.
    """
    rows = sources.withColumn("_cap", F.col("source_size") * repeats).withColumn("_full", F.col("_cap") / F.col("weight"))
    before = running_sums(rows, {"_caps": F.col("_cap"), "_weights": F.col("weight")}, ["_full", "source"])
    all_weights = F.lit(sources.agg(F.sum("weight").alias("w")).first()["w"] or 1.0)
    level = (F.lit(float(budget)) - F.col("_caps")) / (all_weights - F.col("_weights"))
    first = before.withColumn("_level", level).filter("_level <= _full").agg(
        F.min(F.struct("_full", "rank", "_level")).alias("m")).first()["m"]
    share = F.col("weight") * F.lit(first["_level"]) if first else F.col("_cap").cast("double")
    return rows.withColumn("target", F.least(share, F.col("_cap").cast("double"))).drop("_cap", "_full")


def _packets(placed: DataFrame, quantum: int, repeats: int) -> DataFrame:
    """(source, rank, upto, words, finish): `upto` counts the source's words to the packet's end, repeats included."""
    pieces = F.ceil(F.col("size") / quantum).cast("long")
    rows = placed.filter("size > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("_end", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), pieces), lambda k: F.least(k * quantum, F.col("size")))))
    upto = F.col("start") + F.col("_copy") * F.col("source_size") + F.col("_end")
    words = (F.col("_end") - 1) % quantum + 1
    return rows.select("source", "rank", upto.alias("upto"), words.alias("words"), (upto / F.col("weight")).alias("finish"))


def _served(packets: DataFrame, budget: int, rows: int, range_rows: int) -> DataFrame:
    """(source, served): the words each source sends before the budget is spent."""
    order = ["finish", "rank", "upto"]
    cut = range_chunks(packets, order, max(1, -(-rows // range_rows)), rows=rows).withColumnRenamed("_chunk", "_range")
    sums = written_table(cut.groupBy("_range", "source").agg(F.sum("words").alias("words")), "ranges")
    chunks = running_sums(sums.groupBy("_range").agg(F.sum("words").alias("words")), {"before": F.col("words")}, ["_range"])
    last = chunks.filter((F.col("before") < budget) & (F.col("before") + F.col("words") >= budget)).first()
    if last is None:
        return sums.groupBy("source").agg(F.sum("words").alias("served"))
    tail = written_table(cut.filter(F.col("_range") == last["_range"]).drop("_range"), "cut")
    inside = running_sums(tail, {"_before": F.col("words")}, order)
    room = F.lit(budget - last["before"]) - F.col("_before")
    part = inside.select("source", F.greatest(F.lit(0).cast("long"), F.least(room, F.col("words"))).alias("words"))
    return sums.filter(F.col("_range") < last["_range"]).select("source", "words").union(part).groupBy("source").agg(F.sum("words").alias("served"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, resolution: int = RESOLUTION,
             range_rows: int = RANGE_ROWS, key: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """Sizes, queues, targets and what each source sends; documents are read once."""
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.md5(body.cast("binary")).alias("text_md5"), F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":mix")).cast("binary")).alias("_draw"))
    sized = written_table(sized, "sizes")
    placed = running_sums(sized, {"start": F.col("size")}, ["_draw", "text_md5"], ["source"])
    placed = written_table(placed.drop("_draw"), "queues")
    known = _weights(placed, weights)
    total = known.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    known = written_table(targets(known, share * total, repeats), "targets")
    quantum = max(1, total // resolution)
    queued = spread_join(placed, known.select("source", "rank", "weight", "source_size"), ["source"], ["start"])
    packets = placed.agg(F.sum(F.ceil(F.col("size") / quantum)).alias("n")).first()["n"] or 0
    served = _served(_packets(queued, quantum, repeats), int(share * total), int(packets) * repeats, range_rows)
    on = known["source"].eqNullSafe(served["source"])
    known = written_table(known.join(served, on, "left").select(known["*"], F.coalesce("served", F.lit(0)).alias("served")), "served")
    return Mix(placed, known, quantum)


def _share(copy: Column | int) -> Column:
    """Words taken from the copy of a document."""
    copy = copy if isinstance(copy, Column) else F.lit(copy)
    left = F.col("served") - copy * F.col("source_size") - F.col("start")
    return F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size")))


def mix_documents(docs: DataFrame, repeats: int = REPEATS, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    mix = plan_mix(docs, repeats=repeats, **options)
    rows = spread_join(mix.placed, mix.sources.select("source", "source_size", "target", "served"), ["source"], ["start"])
    taken = sum((_share(k) for k in range(1, repeats)), _share(0))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, repeats: int = REPEATS, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself in order: doc_id, source, text, copy, words to take, finish time. Only a source's last document is not taken whole."""
    mix = plan_mix(docs, repeats=repeats, key=key, text=text, source=source, **options)
    rows = spread_join(mix.placed, mix.sources.select("source", "source_size", "weight", "served"), ["source"], ["start"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("words", _share(F.col("copy")))
    finish = (F.col("start") + F.col("copy") * F.col("source_size") + F.col("words")) / F.col("weight")
    rows = rows.filter("words > 0").select("doc_id", "source", "text_md5", "copy", "words", finish.alias("finish"))
    body = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = body.withColumn("_md5", F.md5(F.col("text").cast("binary"))).dropDuplicates(["_id", "_md5"])
    found = rows.join(body, rows["doc_id"].eqNullSafe(body["_id"]) & (rows["text_md5"] == body["_md5"]))
    return found.select("doc_id", "source", "text", "copy", "words", "finish").orderBy("finish", "source", "doc_id", "copy")


def mix_sql(weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, resolution: int = RESOLUTION) -> str:
    given = "[" + ", ".join(f"{float(w)}::DOUBLE" for w in weights) + "]"
    taken = " + ".join(f"greatest(0, least(v.served - {k} * s.source_size - d.start, d.size))" for k in range(repeats))
    return f"""
WITH w AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
      md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS draw, md5(coalesce(text, '')) AS text_md5 FROM documents),
  d AS MATERIALIZED (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM w),
  t AS (SELECT sum(size)::BIGINT AS n, greatest(1, sum(size)::BIGINT // {resolution}) AS q FROM w),
  r AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM w GROUP BY source),
  g AS (SELECT *, {given}[rank % {len(weights)} + 1] AS weight FROM r),
  f AS (SELECT *, ({repeats} * source_size) / weight AS filled, coalesce(sum({repeats} * source_size) OVER o, 0)::DOUBLE AS caps,
      coalesce(sum(weight) OVER o, 0) AS weights FROM g
    WINDOW o AS (ORDER BY ({repeats} * source_size) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  l AS (SELECT arg_min(level, (filled, rank)) AS level FROM (
      SELECT *, ({float(share)}::DOUBLE * (SELECT n FROM t) - caps) / ((SELECT sum(weight) FROM g) - weights) AS level FROM f) WHERE level <= filled),
  s AS MATERIALIZED (SELECT *, least(weight * (SELECT level FROM l), ({repeats} * source_size)::DOUBLE) AS target FROM g),
  p AS (SELECT d.source, s.rank, s.weight, d.start + k.copy * s.source_size + least(x.i * t.q, d.size) AS upto, least(x.i * t.q, d.size) - (x.i - 1) * t.q AS words
    FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, t, range({repeats}) k(copy), LATERAL (SELECT unnest(range(1, (d.size + t.q - 1) // t.q + 1)) AS i) x),
  b AS (SELECT *, sum(words) OVER (ORDER BY upto / weight, rank, upto ROWS UNBOUNDED PRECEDING) - words AS before FROM p),
  v AS (SELECT source, sum(greatest(0, least(words, (SELECT floor({float(share)}::DOUBLE * n)::BIGINT FROM t) - before)))::BIGINT AS served FROM b GROUP BY source)
SELECT d.doc_id, d.size, s.source_size, s.target, coalesce({taken}, 0)::BIGINT AS taken
FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN v ON v.source IS NOT DISTINCT FROM d.source"""
