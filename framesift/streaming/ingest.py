"""Streaming ingestion: files or events arrive, statuses are logged, the latest status wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators import ingest

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, most: int = ingest.MAX_UPLOAD_BYTES) -> DataFrame:
    """New files under a folder with their type, hash and reject reason."""
    return ingest.ingest(spark.readStream.format("binaryFile").schema(FILES).load(path), most=most)


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Gives all that has arrived to `handle` batch by batch, then stops; begun batches are taken up again."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(log: DataFrame) -> DataFrame:
    """Append-only log (id, status, at) -> the last status of each id; ties go to the later name."""
    return log.groupBy("id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))


def event_counts(events: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events by window and type; state older than the lateness is let go."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def wrong_steps(log: DataFrame, allowed: Callable) -> DataFrame:
    """Log (id, status, at) -> its entries whose step from the one before is not allowed(before, after); a first
    entry has to be `queued`. Entries of one time go by name."""
    before = F.lag("status").over(Window.partitionBy("id").orderBy("at", "status"))
    steps = log.withColumn("before", before)
    return steps.filter(F.when(F.col("before").isNull(), F.col("status") != "queued").otherwise(~allowed(F.col("before"), F.col("status"))))


def every(spark: SparkSession, seconds: float, action: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """Runs an action, such as a cleanup, once an interval until the query is stopped."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda _, no: action(no)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
