"""Registration of queries, input tables, and derived inputs shared with the SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.tables import fill_cores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The wanted columns, in enough splits for work that is heavy per row."""
    return fill_cores(table(spark, folder, name).select(*columns))


# The test tables hold no nulls: both sides derive them in the same way.
EVENTS_NULLS = """(SELECT event_id, ts, user_id,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"""


def events_nulls(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )


DAILY_REVENUE = """(SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day,
    round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1)"""


def daily_revenue(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )


DAILY_EVENTS = """(SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value), 2) AS total,
    count(*) AS n FROM events GROUP BY 1, 2)"""


def daily_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.round(F.sum("value"), 2).alias("total"), F.count(F.lit(1)).alias("n")
    )


# A deterministic stand-in for a classifier's output.
SCORED_DOCS = """(SELECT d.doc_id, l.quality AS label, (d.n_chars * 37 + d.doc_id * 17) % 1000 / 1000.0::DOUBLE AS p
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scored_docs(spark: SparkSession, folder: str) -> DataFrame:
    d, lab = table(spark, folder, "documents"), table(spark, folder, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("quality").alias("label"),
        ((F.col("n_chars") * 37 + F.col("doc_id") * 17) % 1000 / F.lit(1000.0)).alias("p"),
    )


PREDICTED_LANG = """(SELECT doc_id, lang AS label,
    CASE WHEN (doc_id * 7 + n_chars) % 10 < 6 THEN lang
         WHEN (doc_id * 7 + n_chars) % 10 = 6 THEN 'de' WHEN (doc_id * 7 + n_chars) % 10 = 7 THEN 'en'
         WHEN (doc_id * 7 + n_chars) % 10 = 8 THEN 'es' ELSE 'fr' END AS prediction, n_chars FROM documents)"""


def predicted_lang(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    draw = (F.col("doc_id") * 7 + F.col("n_chars")) % 10
    return d.select(
        "doc_id", F.col("lang").alias("label"),
        F.when(draw < 6, F.col("lang")).when(draw == 6, "de").when(draw == 7, "en").when(draw == 8, "es")
        .otherwise("fr").alias("prediction"),
        "n_chars",
    )
