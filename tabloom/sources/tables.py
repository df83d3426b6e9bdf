"""Files to tables and back: format by extension, previews, inline records, nested JSON."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import clean_non_finite
from .csv_records import read_spanning, spans_lines
from .excel import read_excel

# Accepted formats, delimiters, and the preview limits.
FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "xlsx": "excel"}
DELIMITERS = (",", ";", "\t", "|")
PREVIEW_DEFAULT, PREVIEW_MAX = 10, 100


def format_of(path: str) -> str:
    extension = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if extension == "xls":
        raise ValueError("binary .xls workbooks are not supported; save them as .xlsx")
    if extension not in FORMATS:
        raise ValueError(f"unsupported file type: {path}")
    return FORMATS[extension]


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    delimiter: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """One reader for every format. A declared schema saves the inference pass over the files.

    CSV with line breaks in quoted values is recognised and its records are joined in
    parallel (`csv_records`); `multi_line` uses Spark's own reader for it, one task per file.
    """
    fmt = fmt or format_of(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "parquet":
        out = reader.parquet(path)
    elif fmt == "csv":
        if delimiter not in DELIMITERS:
            raise ValueError(f"unsupported delimiter: {delimiter!r}")
        if not multi_line and spans_lines(spark, path):
            out = read_spanning(spark, path, delimiter, schema)
        else:
            out = reader.csv(path, header=True, sep=delimiter, inferSchema=schema is None, multiLine=multi_line, escape='"')
    elif fmt == "json":
        out = reader.json(path, multiLine=True)
    elif fmt == "jsonl":
        out = reader.json(path)
    elif fmt == "excel":
        out = read_excel(spark, path, schema)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    if not out.columns:
        raise ValueError(f"no columns in {path}")
    return out


def fill_cores(scan: DataFrame) -> DataFrame:
    """Spread a freshly read table that comes in fewer splits than there are cores.

    For work that is heavy per row (text). A large table has more splits than cores and
    is returned as it is: no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def reject_empty(df: DataFrame) -> DataFrame:
    """Raise when the table has no rows; reads at most one row."""
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported sink format: {fmt}")
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    """Scored rows, flagged anomalies or forecasts as CSV parts with a header."""
    return write_table(df, path, "csv")


def preview(df: DataFrame, order_by: Sequence[str], limit: int = PREVIEW_DEFAULT, most: int = PREVIEW_MAX) -> DataFrame:
    """The first `limit` rows, at least one and no more than `most`; non-finite numbers as null."""
    limit = max(1, min(most, limit))
    return clean_non_finite(df.orderBy(*order_by).limit(limit))


def preview_document(df: DataFrame, order_by: Sequence[str], limit: int = PREVIEW_DEFAULT) -> dict:
    return {
        "columns": df.columns,
        "total_rows": df.count(),
        "rows": [r.asDict() for r in preview(df, order_by, limit).collect()],
    }


def from_records(spark: SparkSession, records: Iterable[dict], schema: T.StructType | str | None = None) -> DataFrame:
    """Inline records to a table; a key missing in a record is null."""
    records = list(records)
    if schema is None:
        names = list(dict.fromkeys(k for r in records for k in r))
        records = [{n: r.get(n) for n in names} for r in records]
        return spark.createDataFrame(records).select(*[F.col(f"`{n}`") for n in names])
    return spark.createDataFrame(records, schema)


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects to dotted columns at every depth; lists stay values."""

    def leaves(struct: T.StructType, path: list[str]):
        for f in struct.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here))

    return df.select(*leaves(df.schema, []))


def _without_void(kind: T.DataType) -> T.DataType:
    """Text where only nulls were seen, at every depth."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_without_void(kind.elementType), kind.containsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _without_void(f.dataType), f.nullable) for f in kind.fields])
    return kind


def expand_json(df: DataFrame, column: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A text column with one JSON object per row becomes dotted columns next to the others.

    Without a schema it is inferred by one distributed pass over the texts.
    """
    if schema is None:
        seen = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(f"`{column}`")))).first()[0]
        # Quoted names are passed over, so that only types are changed.
        ddl = re.sub(r"(`(?:[^`]|``)*`)|\bOBJECT<", lambda m: m[1] or "STRUCT<", seen)
        schema = _without_void(T.DataType.fromDDL(ddl))
    return flatten(df.withColumn(column, F.from_json(F.col(f"`{column}`"), schema)))


def explode_payload(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """A text column holding one object or an array of objects: one flattened row per object."""
    many = F.from_json(F.col(column), T.ArrayType(schema))
    return flatten(df.select(F.explode(many).alias("event")).select("event.*"))


def demo_table(spark: SparkSession, rows: int = 300, seed: int = 42) -> DataFrame:
    """Seeded example rows: Age, Salary, Experience, Churn."""
    return spark.range(rows).select(
        F.floor(F.rand(seed) * 52 + 18).cast("double").alias("Age"),
        (F.randn(seed + 1) * 15000 + 55000).alias("Salary"),
        F.floor(F.rand(seed + 2) * 19 + 1).cast("int").alias("Experience"),
        (F.rand(seed + 3) < 0.3).cast("int").alias("Churn"),
    )
