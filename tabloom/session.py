"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "tabloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's shared folder (`spark.checkpoint.dir`).

    Only a local session may fall back to a folder of this machine: on a cluster
    other machines could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str | int) -> Iterator[None]:
    """What is run within it has the setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """What is run within it gives the disk of its shuffles back when it ends, not when the driver collects garbage."""
    return setting(spark, SHUFFLE_CLEANUP, "true")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], after: Callable[[], None] | None = None):
    """The task function, giving its memory back to the system when the task ends.

    Python workers outlive their tasks, and what the allocators keep of one stage would be
    missing in the next one. `after` drops what the module itself keeps.
    """

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if after is not None:
                after()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform.startswith("linux"):
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim is not None:
                    trim(0)

    return tidied


def written_table(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` once below the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors; used where a costly
    intermediate result is read more than once.
    """
    path = shared_folder(df.sparkSession, purpose)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def drop_written(*tables: DataFrame) -> None:
    """Deletes the files of tables that `written_table` returned and that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
