"""Helpers shared by the operators: input tables, ranks without one big task, components."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.session import drop_written, tidy, written_table  # noqa: F401


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Steps that run within it send whole texts to Python `rows` at a time.

    A batch is held by the JVM, outside its heap, and by the Python worker; with Spark's usual
    10,000 rows the buffers of a few tasks come to hundreds of MB. Written results only: a plan
    takes the setting when it is run.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def uniform(*columns):
    """A number in (0, 1) from a 64-bit hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / float(2**53)


def running_start(df: DataFrame, group: list[str], key: list[str], amount, out: str, rows_per_block: int = 20_000) -> DataFrame:
    """Adds `out`: the sum of `amount` over the rows of the same group that come before.

    Within a group rows are ordered by a block number, which is a hash of `key`, then by
    `key`. No task holds a whole group: a block has about `rows_per_block` rows of the
    table, block totals are summed first, and only these totals meet in one window per
    group. Groups with null keys are groups of their own. Rows that agree on `key` share a
    block in any order.
    """
    blocks = max(1, -(-df.count() // rows_per_block))
    cut = df.withColumn("_block", F.pmod(F.xxhash64(*key), F.lit(blocks))).withColumn("_amount", amount.cast("long"))
    totals = cut.groupBy(*group, "_block").agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_block").alias("_b"),
                           F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    same = F.col("_block") == F.col("_b")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    within = Window.partitionBy(*group, "_block").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(totals, same).drop("_b", *[f"_g_{c}" for c in group])
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum("_amount").over(within), F.lit(0))).drop("_block", "_amount", "_before")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over `edges` (columns a, b), for every node that has an edge.

    Large-star and small-star steps (Kiveris et al., 2014) until nothing changes. Each step
    is an aggregate with map-side minimum and a join, so a node with very many links is
    split by the adaptive skew join. Each round is written to the shared folder, so a lost
    executor costs one round.
    """
    current = written_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = current.union(current.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, current = current, written_table(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        drop_written(last)
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], spread_by: list[str], salts: int = 32) -> DataFrame:
    """Inner join to a table with one row per key, nulls matching nulls; a key's rows are dealt to `salts` groups by hash."""
    copies = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in table.columns if c not in keys],
                          F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_copy"))
    same = F.col("_salt") == F.col("_copy")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return salted.join(copies, same).drop("_salt", "_copy", *[f"_k_{k}" for k in keys])
