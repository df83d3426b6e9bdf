"""Prefix trie of conversations, by collapsing whole sequences.

Conversations are first rebuilt: conversation c takes the first h turns of its base
c - c % 100 and then its own turns after the first h, h = crc32(c) % 6. Equal rebuilt
conversations collapse to one weighted sequence with the list of those that end there.
Only distinct sequences are expanded to prefixes. A sequence that is a proper prefix of
another one is dropped by an anti-join; the rest are the leaves. All else is sums of
weighted prefixes over the nodes.

Texts are read once and stay out of every shuffle: a turn is the MD5 of role and text and
the length of the text. A prefix is the sum, over its turns, of four 32-bit lanes of
MD5(depth, turn); sums need no order, so a conversation of any length is added up with
map-side combining, and only the prefixes of representatives are running sums
(`ordered.running_sums`, which cuts a very long conversation into ranges).

The saving below a node is summed without descending level by level: each node belongs to
its smallest leaf, nodes of one leaf are a chain, so

    saved(v) = sum of the chain totals of all leaves below v - the part of v's own chain above v.

The ids that end in a sequence are joined in blocks of 65,536 ids at most and hashed as a
stream, so a sequence that a third of all conversations share needs one block of memory.

Edge cases: null role and text are empty; null turns come first; rows of one turn follow
role, then the MD5 of role and text; repeated rows are turns of their own; rows without a
conversation id belong to no conversation and are left out; a conversation without turns
of its own kind may become turnless and then ends in the root; an empty table has no node,
not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ordered import row_position, running_sums
from tabloom.session import written_table

LANES = ["a", "b", "c", "d"]
NODE = ["depth", *LANES]
PARENT = [f"p{x}" for x in LANES]
#: Width of a block of conversation ids whose ends are joined in one row.
BLOCK = 65_536


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Written table (conv_id, place from 0, turn, chars), `turn` the MD5 of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("_known"), F.col("turn").alias("_turn"),
        role.alias("_role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(","), role, text).cast("binary")).alias("turn"),
        F.length(text).cast("long").alias("chars"))
    placed = row_position(rows, ["_known", "_turn", "_role", "turn"], ["conv_id"], name="place")
    return written_table(placed.select("conv_id", "place", "turn", "chars"), "turns")


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, depth, turn, chars) of every rebuilt conversation; depth 0 is a textless row that each one has."""
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = F.array_sort(F.collect_list(F.struct("place", "turn", "chars")))
    bases = turns.filter((F.col("conv_id") % group == 0) & (F.col("place") < heads - 1)).groupBy(
        F.col("conv_id").alias("_base")).agg(first.alias("_first"))
    held = F.coalesce(F.size("_first"), F.lit(0))
    held = F.when(held < 0, 0).otherwise(held)

    known = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("_base", base).join(bases, "_base", "left")
    taken = F.slice(F.coalesce("_first", F.array().cast("array<struct<place:bigint,turn:string,chars:bigint>>")), 1, h.cast("int"))
    top = F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.lit("").alias("turn"), F.lit(0).cast("long").alias("chars")))
    starts = known.select("conv_id", F.explode(F.concat(top, taken)).alias("t")).select(
        "conv_id", (F.col("t.place") + 1).alias("depth"), "t.turn", "t.chars")
    own = turns.filter(F.col("place") >= h).withColumn("_base", base).join(bases.select("_base", held.alias("_held")), "_base", "left")
    shift = F.least(h, F.coalesce("_held", F.lit(0)).cast("long")) - h
    return starts.union(own.select("conv_id", (F.col("place") + shift + 1).alias("depth"), "turn", "chars"))


def _with_lanes(rows: DataFrame) -> DataFrame:
    """Adds four numbers below 2**32 from the MD5 of depth and turn."""
    digest = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn")).cast("binary"))
    hashed = rows.withColumn("_digest", digest)
    return hashed.withColumns({x: F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i, x in enumerate(LANES)}).drop("_digest")


def _ends(members: DataFrame) -> DataFrame:
    """(n, lanes, ends_sha256): SHA-256 of the joined ids of the conversations that are exactly this sequence."""
    key = ["depth", *LANES]
    blocks = members.withColumn("_block", F.floor(F.col("conv_id") / BLOCK).cast("long")).groupBy(*key, "_block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    in_order = blocks.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, "_block").select(*key, "ids")
    names = [*key, "ends_sha256"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for *group, ids in zip(*columns):
                if group != current:
                    if state is not None:
                        done.append([*current, state.hexdigest()])
                    current, state = group, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in [*current, state.hexdigest()]], names=names)

    return in_order.mapInArrow(digests, "depth long, a long, b long, c long, d long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = written_table(_with_lanes(rebuilt(turn_rows(conversations), group, heads)), "rebuilt")
    sums = [F.sum(x).alias(x) for x in LANES]
    members = written_table(rows.groupBy("conv_id").agg(F.max("depth").alias("depth"), *sums), "members")
    sequences = members.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"))
    reps = written_table(sequences, "sequences")

    own = rows.join(reps.select(F.col("rep").alias("conv_id"), "weight", F.col("depth").alias("n")), "conv_id")
    chain = running_sums(own, {f"p{x}": F.col(x) for x in LANES}, ["depth"], ["conv_id"])
    prefixes = written_table(chain.select(
        F.col("conv_id").alias("rep"), "weight", "n", "chars", "depth", *PARENT, *[(F.col(f"p{x}") + F.col(x)).alias(x) for x in LANES]), "prefixes")

    proper = prefixes.filter("depth < n").select(*NODE).distinct()
    leaves = reps.join(proper, NODE, "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    paths = written_table(prefixes.join(leaves, "rep", "left"), "paths")
    nodes = paths.groupBy(*NODE).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf") == 1, F.col("rep"))).alias("chain"), F.max("chars").alias("chars"),
        *[F.max(p).alias(p) for p in PARENT])
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    nodes = written_table(running_sums(nodes, {"above": F.col("saved")}, ["depth"], ["chain"]), "nodes")

    totals = nodes.groupBy(F.col("chain").alias("rep")).agg(F.sum("saved").alias("total"))
    none, zero = F.lit(None).cast("string").alias("ends_sha256"), F.lit(0).cast("long")
    facts = (
        paths.filter("leaf = 1").join(totals, "rep").select(*NODE, "total", zero.alias("children"), none)
        .union(nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), *[F.col(f"p{x}").alias(x) for x in LANES],
                                                zero.alias("total"), F.lit(1).cast("long").alias("children"), none))
        .union(_ends(members).select(*NODE, zero.alias("total"), zero.alias("children"), "ends_sha256"))
    )
    facts = facts.groupBy(*NODE).agg(F.sum("total").alias("total"), F.sum("children").alias("n_children"), F.max("ends_sha256").alias("ends_sha256"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(x).alias(f"p{x}") for x in LANES], F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(facts, NODE).join(above, ["depth", *PARENT], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("total") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def with_turns(nodes: DataFrame, conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """The nodes with role and text of their last turn (null at the root).

    A node's turn is turn `depth` of its smallest member; texts are fetched by their MD5.
    """
    turns = turn_rows(conversations)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(","), role, text).cast("binary"))
    texts = conversations.filter("conv_id IS NOT NULL").select(digest.alias("turn"), role.alias("role"), text.alias("text")).dropDuplicates(["turn"])
    at = nodes.join(rebuilt(turns, group, heads).select("conv_id", "depth", "turn"), ["conv_id", "depth"])
    return at.join(texts, "turn", "left").drop("turn")


def trie_sql(group: int = 100, heads: int = 6) -> str:
    """The same nodes in SQL; prefixes are joined strings of turn digests."""
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL),
  u AS (SELECT conv_id, turn, role, length(txt) AS chars, md5(length(role)::VARCHAR || ',' || role || txt) AS digest FROM t),
  own AS (SELECT conv_id, digest, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) - 1 AS place FROM u),
  c AS (SELECT conv_id, conv_id - conv_id % {group} AS base, xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for x in string_split(conv_id::VARCHAR, '')])),
      lambda s, v: xor(xor(s, v) >> 1, 3988292384::BIGINT * (xor(s, v) & 1))), 4294967295::BIGINT) % {heads} AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
  head AS (SELECT c.conv_id, o.place + 1 AS depth, o.digest, o.chars FROM c JOIN own o ON o.conv_id = c.base AND o.place < c.h),
  k AS (SELECT conv_id, h, (SELECT count(*) FROM head WHERE head.conv_id = c.conv_id) AS held FROM c),
  r AS (SELECT * FROM head UNION ALL
    SELECT o.conv_id, o.place - k.h + k.held + 1, o.digest, o.chars FROM own o JOIN k USING (conv_id) WHERE o.place >= k.h
    UNION ALL SELECT conv_id, 0, '', 0 FROM c),
  pre AS MATERIALIZED (SELECT conv_id, depth, chars, string_agg(digest, '') OVER w AS path, max(depth) OVER (PARTITION BY conv_id) AS n
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
  link AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM pre),
  node AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, min(up) AS up, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
    FROM link GROUP BY path, depth),
  kids AS (SELECT up AS path, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
  full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (path, depth)),
  below AS (SELECT p.path, p.depth, sum(f.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves
    FROM full_node f JOIN pre p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens, f.ends_sha256
FROM full_node f JOIN below b USING (path, depth) LEFT JOIN node g ON g.path = f.up AND g.depth = f.depth - 1"""
