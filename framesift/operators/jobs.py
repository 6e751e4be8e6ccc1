"""Job ledger: lookup, recent, history search, expiry, update, delete, retention."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ingest

ACTIVE = ("queued", "processing")
RECENT_DEFAULT, RECENT_MOST = 50, 200


def get(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("id") == job_id)


def require(jobs: DataFrame, job_id: str) -> DataFrame:
    """As get, but a job that isn't there is an error."""
    found = get(jobs, job_id)
    if found.isEmpty():
        raise KeyError(job_id)
    return found


def recent(jobs: DataFrame, limit: int = RECENT_DEFAULT) -> DataFrame:
    """Newest first, ties by id; a top-k, never a full sort."""
    if not 1 <= limit <= RECENT_MOST:
        raise ValueError(f"limit must lie in 1..{RECENT_MOST}")
    return jobs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def search(jobs: DataFrame, text: str, status: str | None = None, limit: int = 100) -> DataFrame:
    """Of the most recent jobs, those whose name or id contains the text and whose status fits."""
    needle = text.strip().lower()
    hit = F.contains(F.lower("source_name"), F.lit(needle)) | F.contains(F.lower("id"), F.lit(needle))
    return recent(jobs, limit).filter(hit if status is None else hit & (F.col("status") == status))


def expired_at(cutoff: Column) -> Column:
    return (F.col("updated_at") < cutoff) & ~F.col("status").isin(*ACTIVE)


def cutoff(now: datetime.datetime, retention_hours: float) -> datetime.datetime:
    """now must carry a time zone."""
    if now.tzinfo is None:
        raise ValueError("now must be timezone-aware")
    return now - datetime.timedelta(hours=retention_hours)


def expired(jobs: DataFrame, before: Column) -> DataFrame:
    return jobs.filter(expired_at(before)).orderBy("updated_at", "id")


def delete(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    return jobs.join(keys.select("id"), "id", "left_anti")


def update(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (id, status, updated_at, error, result): status and time replace, error replaces even by
    null, result only where it is given. Each id changes once at most."""
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in ("status", "updated_at", "error", "result")], F.lit(True).alias("_changed"))
    keep = {"status": F.col("_status"), "updated_at": F.col("_updated_at"), "error": F.col("_error"), "result": F.coalesce("_result", "result")}
    return jobs.join(new, "id", "left").select(*[F.when(F.col("_changed"), keep[c]).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in jobs.columns])


def status_of(modules: Column) -> Column:
    """completed only if every module completed; a skipped one counts against it."""
    return F.when(F.exists(modules, lambda m: m["status"] != "completed"), "partially_completed").otherwise("completed")


def retention_plan(jobs: DataFrame, before: Column, safe: Column) -> DataFrame:
    """Expired jobs as rows (id, safe): whether all their paths may be removed."""
    return jobs.filter(expired_at(before)).select("id", safe.alias("safe"))


def retention_counts(plan: DataFrame) -> DataFrame:
    """One row of counts over a retention plan."""
    return plan.agg(F.count("*").alias("expired"), F.count_if("safe").alias("deleted"), F.count_if(~F.col("safe")).alias("failed"))


def checked_paths(jobs: DataFrame, before: Column, paths: Column) -> DataFrame:
    """Expired jobs as rows (id, failure): all of a job's paths (an array) are looked at before any may be
    removed; failure names the first that leaves its folder and is null if the job may go."""
    outside = F.get(F.filter(paths, lambda p: ~F.coalesce(ingest.stays_inside(p), F.lit(False))), F.lit(0))
    unsafe = F.exists(paths, lambda p: ~F.coalesce(ingest.stays_inside(p), F.lit(False)))
    return jobs.filter(expired_at(before)).select("id", F.when(unsafe, F.concat(F.lit("path leaves its folder: "), F.coalesce(outside, F.lit("null")))).alias("failure"))


def cleanup(jobs: DataFrame, files: DataFrame, now: datetime.datetime, retention_hours: float, paths: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(kept ledger, checked rows (id, failure), stale unfinished uploads (path), one row of counts).

    A job that fails is kept and stands in nobody's way. What the rows name is removed by the caller; files
    are a listing (path, modificationTime).
    """
    before = F.lit(cutoff(now, retention_hours))
    checked = checked_paths(jobs, before, paths)
    stale = stale_parts(files, before)
    counts = checked.agg(F.count("*").alias("expired_jobs"), F.count_if(F.col("failure").isNull()).alias("deleted_jobs"), F.count("failure").alias("failed_jobs")).crossJoin(stale.agg(F.count("*").alias("deleted_temporary_uploads")))  # single rows
    return delete(jobs, checked.filter("failure IS NULL")), checked, stale.select("path"), counts


def ids_sha256(ids: DataFrame, block_bytes: int = 8 << 10) -> DataFrame:
    """ids (id: string) -> one row (sha256) of all ids in order, joined by commas; nulls are left out.

    Ids are sorted in many tasks, each of which joins stretches of them into blocks. SHA-256 has to read
    bytes in order, so one task reads the blocks, one after the other; no list of all ids is ever held.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda held: pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([",".join(held).encode()], pa.binary())], ["id", "block"])
        held, size = [], 0
        for batch in batches:
            for i in batch.column(0).to_pylist():
                if held and size >= block_bytes and i != held[-1]:  # equal ids stay in one block, so blocks have one order
                    yield row(held)
                    held, size = [], 0
                held.append(i)
                size += len(i) + 1
        if held:
            yield row(held)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, first = hashlib.sha256(), True
        for batch in batches:
            for block in batch.column(1).drop_null():
                found.update(b"" if first else b",")
                found.update(block.as_py())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([found.hexdigest()])], ["sha256"])

    spark = ids.sparkSession
    none = spark.createDataFrame([(None, None)], "id string, block binary")
    told = ids.select("id").filter("id IS NOT NULL").repartitionByRange("id").sortWithinPartitions("id").mapInArrow(blocks, "id string, block binary")
    # A block of nothing makes sure that there is a task, and a digest, where there are no ids.
    return told.union(none).repartition(1).sortWithinPartitions("id").mapInArrow(digest, "sha256 string")


def stale_parts(files: DataFrame, before: Column) -> DataFrame:
    """Listed files (path, modificationTime) that are unfinished uploads older than the cutoff."""
    return files.filter(F.endswith("path", F.lit(".part")) & (F.col("modificationTime") < before)).select("path", "modificationTime")


class Throttle:
    """Runs something at most once an interval unless forced."""

    def __init__(self, interval_seconds: float) -> None:
        self.interval, self.last = interval_seconds, None

    def due(self, now: float, force: bool = False) -> bool:
        if force or self.last is None or now - self.last >= self.interval:
            self.last = now
            return True
        return False
