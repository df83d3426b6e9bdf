"""Sharding by a hierarchical weighted hash tree (regions, racks, shards).

A row descends three levels. On each level every child draws `-ln(u) / weight`, where `u`
is a hash of the row's key and the child's place in the tree, and the smallest draw wins
(weighted rendezvous). A subtree's weight is the sum of its shards' weights, so a changed
weight moves rows only into or out of the subtrees above it, and a new region takes rows
only into itself.

Edge cases: a null key is hashed like any other value, so such rows share a shard; a null
text has size 8 and the checksum of no bytes; an empty table gives an empty result; equal
keys share a shard and get different slots; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_start, uniform

Tree = list[list[list[float]]]
#: 24 shards of equal weight: two regions of three racks of four shards.
TREE_24: Tree = [[[1.0] * 4] * 3] * 2


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return [*tree, [[weight]]]


def _literal(numbers) -> Column:
    return F.array(*[_literal(x) if isinstance(x, list) else F.lit(float(x)) for x in numbers])


def _draw(weights: Column, *path) -> Column:
    """Number of the child with the smallest weighted draw; children of weight 0 never win."""
    draws = F.transform(weights, lambda w, i: F.struct(
        F.when(w > 0, -F.ln(uniform(*path, i)) / w).otherwise(F.lit(float("inf"))).alias("draw"), i.alias("i")))
    return F.array_min(draws)["i"]


def place(df: DataFrame, tree: Tree, key: str = "doc_id", prefix: str = "") -> DataFrame:
    """Adds region, rack (within the region) and shard (numbered through the tree) as `prefix` + name."""
    if any(w < 0 for region in tree for rack in region for w in rack) or not any(w > 0 for region in tree for rack in region for w in rack):
        raise ValueError("shard weights must not be negative, and one must be positive")
    racks = [[sum(rack) for rack in region] for region in tree]
    first, start = [], 0
    for region in tree:
        first.append([])
        for rack in region:
            first[-1].append(float(start))
            start += len(rack)
    region, rack, shard = (f"{prefix}{c}" for c in ("region", "rack", "shard"))
    k = F.col(key)
    df = df.withColumn(region, _draw(_literal([sum(r) for r in racks]), k, F.lit("region")))
    df = df.withColumn(rack, _draw(_literal(racks)[F.col(region)], k, F.lit("rack"), F.col(region)))
    leaf = _draw(_literal(tree)[F.col(region)][F.col(rack)], k, F.lit("shard"), F.col(region), F.col(rack))
    return df.withColumn(shard, (leaf + _literal(first)[F.col(region)][F.col(rack)]).cast("int"))


def shard_documents(docs: DataFrame, tree: Tree = TREE_24, larger: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size (UTF-8 bytes plus 8), checksum, place in `tree`, gapless slot within the shard, shard in `larger`.

    Placement is a row-wise expression. Slots come from block totals (`running_start`), so
    no task holds a shard.
    """
    rows = docs.select(F.col(key), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = place(rows, tree, key)
    if larger is not None:
        rows = place(rows, larger, key, "grown_")
    return running_start(rows, ["shard"], [key, "text_crc32"], F.lit(1), "slot")


def write_shards(docs: DataFrame, path: str, tree: Tree = TREE_24, key: str = "doc_id", files_per_shard: int = 8) -> None:
    """Writes the documents with their place, a folder for each shard; a shard's rows are dealt to several tasks."""
    placed = place(docs, tree, key)
    placed.repartition("shard", F.pmod(F.xxhash64(key), F.lit(files_per_shard))).write.partitionBy("shard").parquet(path)
