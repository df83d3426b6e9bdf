"""CSV records that span lines, joined in parallel.

Files are read as lines, split like any text. A line break belongs to a value if the
quotes before it are odd in number; so the quotes of each split are counted, summed up
over the splits of a file, and every line then knows whether it starts a record. Lines of
one record are joined, with a mark in place of the line break that the data does not
hold, and the records are written one per line for Spark's own CSV reader.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: Characters that may stand for a line break; the first one the data does not hold is taken.
MARKS = ("\u001e", "\u001f", "\ue000", "\uf8ff")


def _quotes() -> Column:
    return F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(f, b, i, value): a line with its file, the start of its split, and its order within the split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether any line holds an odd number of quotes; one pass, without a shuffle."""
    return bool(text_lines(spark, path).agg(F.bool_or(_quotes() % 2 == 1)).first()[0])


def records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(f, record from 1, text): whole records in any order. Raises where a file's last quote is left open."""
    order = Window.partitionBy("f", "b").orderBy("i")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = text_lines(spark, path).withColumn("_q", _quotes()).withColumn("_odd", F.coalesce(F.sum("_q").over(earlier), F.lit(0)) % 2)
    blocks = lines.groupBy("f", "b").agg(F.sum("_q").alias("q"), F.count_if(F.col("_odd") == 0).alias("s0"), F.count_if(F.col("_odd") == 1).alias("s1"))
    # One row per split of a file.
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_open", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2).withColumn(
        "_starts", F.when(F.col("_open") == 0, F.col("s0")).otherwise(F.col("s1")))
    blocks = blocks.withColumn("_done", F.coalesce(F.sum("_starts").over(before), F.lit(0)))
    total = F.sum("q").over(Window.partitionBy("f"))
    blocks = blocks.withColumn("_done", F.when(total % 2 == 0, F.col("_done")).otherwise(
        F.raise_error(F.concat(F.lit("a quote is left open in "), F.col("f")))))
    placed = lines.join(blocks.select("f", "b", "_open", "_done"), ["f", "b"]).withColumn("_starts", (F.col("_odd") == F.col("_open")).cast("int"))
    placed = placed.withColumn("record", F.col("_done") + F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    alone = (F.col("_starts") == 1) & (F.col("_q") % 2 == 0)
    parts = F.array_sort(F.collect_list(F.struct("b", "i", "value")))
    joined = placed.filter(~alone).groupBy("f", "record").agg(F.array_join(F.transform(parts, lambda p: p["value"]), mark).alias("text"))
    both = placed.filter(alone).select("f", "record", F.col("value").alias("text")).union(joined)
    return both.withColumn("text", F.regexp_replace("text", "\r$", ""))


def _header(line: str, delimiter: str) -> list[str]:
    """Column names as Spark gives them: empty ones by number, repeated ones with their number."""
    names = next(csv.reader([line], delimiter=delimiter))
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else (f"{n}{i}" if lower.count(n.lower()) > 1 else n) for i, n in enumerate(names)]


def read_spanning(spark: SparkSession, path: str, delimiter: str, schema: T.StructType | str | None) -> DataFrame:
    """The table of CSV files whose quoted values hold line breaks; each file starts with the same header."""
    held = text_lines(spark, path).agg(*[F.bool_or(F.contains("value", F.lit(m))).alias(f"m{i}") for i, m in enumerate(MARKS)]).first()
    free = [m for i, m in enumerate(MARKS) if not held[i]]
    if not free:
        raise ValueError("no character is left to stand for line breaks")
    mark, scratch = free[0], shared_folder(spark, "records")
    found = records(spark, path, mark)
    # The header takes part in the count, so it is known once the records are written.
    found.write.parquet(scratch + "-all")
    found = spark.read.parquet(scratch + "-all")
    first = found.filter("record = 1").orderBy("f").limit(1).first()
    found.filter("record > 1").select("text").write.text(scratch)
    reader = spark.read if schema is None else spark.read.schema(schema)
    out = reader.csv(scratch, header=False, sep=delimiter, inferSchema=schema is None, escape='"')
    if schema is None:
        out = out.toDF(*_header(first["text"], delimiter))
    texts = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType)]
    return out.withColumns({n: F.translate(F.col(f"`{n}`"), mark, "\n") for n in texts})
