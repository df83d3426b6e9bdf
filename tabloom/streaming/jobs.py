"""Streams of event files, and how they run.

Each job is an ordinary streaming query with a checkpoint. Run once over what has
arrived (`availableNow`, started by any scheduler) or continuously on a preset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import guard
from ..sources.tables import flatten
from ..operators.models import TrainedModel
from ..operators.score import score_batch

# Run presets and their distance.
PRESETS = {
    "Every 15 Minutes": "15 minutes",
    "Hourly": "1 hour",
    "Daily at Midnight": "1 day",
    "Weekly on Sunday": "7 days",
}
RECEIPT_ROWS = 3


def read_events(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "json",
                glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New files of the landing folder. A JSON file holds lines, or one array or object (`multiLine`)."""
    reader = spark.readStream.schema(schema)
    if fmt == "json":
        reader = reader.option("multiLine", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format("json" if fmt in ("json", "jsonl") else fmt).load(folder)


def flattened_events(stream: DataFrame) -> DataFrame:
    return flatten(stream)


def guarded_events(stream: DataFrame, fitted: dict, action: str = "flag") -> DataFrame:
    """Bounds learned on history, applied row by row: no state."""
    return guard.apply_bounds(stream, fitted, action)


def deduplicated_events(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each key; the state is bounded by the watermark."""
    timed = stream
    if isinstance(stream.schema[event_time].dataType, T.TimestampNTZType):
        timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def scored_events(stream: DataFrame, trained: TrainedModel) -> DataFrame:
    """The fitted pipeline on live rows: no state."""
    return score_batch(stream, trained)


def start(stream: DataFrame, sink: str, checkpoint: str, preset: str | None = None) -> StreamingQuery:
    """Append to a Parquet folder, on a preset distance or once over everything that is there."""
    writer = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=PRESETS[preset]) if preset else writer.trigger(availableNow=True)
    return writer.outputMode("append").start()


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Process what has arrived, then read the sink."""
    start(stream, sink, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def start_with_receipts(stream: DataFrame, sink: str, receipts: str, checkpoint: str) -> StreamingQuery:
    """As `start`, plus one receipt per batch: rows, columns and a sample of three rows as JSON.

    A batch that is repeated after a failure overwrites its own folder.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
            sample = [r[0] for r in batch.limit(RECEIPT_ROWS).select(F.to_json(F.struct("*"))).collect()]
            batch.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(batch_id).cast("long").alias("batch_id"), "rows",
                F.array(*[F.lit(c) for c in batch.columns]).alias("columns"),
                F.array(*[F.lit(s) for s in sample]).cast("array<string>").alias("sample"),
            ).write.mode("overwrite").parquet(f"{receipts}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
