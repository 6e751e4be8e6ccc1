"""Lineage is cut in the cluster's shared checkpoint folder, so that lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of stored frames by application, until they are released.
_STORED: dict[str, list[str]] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that spark.checkpoint.dir names. Where it is unset, a local session gets a temporary
    folder of its own; on a cluster that is an error, as no machine's folder is seen by the others."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="framesift-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


class _FreedShuffles:
    """While it lasts, the shuffle files of a finished query go at once, not with the driver's next
    collection of garbage. Spark reads that setting as a frame is made, hence a select before the action."""

    def __init__(self, spark: SparkSession) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(_CLEANUP, "false")
        self.conf.set(_CLEANUP, "true")

    def __exit__(self, *_: object) -> None:
        self.conf.set(_CLEANUP, self.before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    with _FreedShuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like cut, but a Parquet table in the shared folder: for frames of many narrow rows, whose checkpoint
    would hold each column of each row in eight bytes and more. It stays until it is released."""
    spark = df.sparkSession
    at = shared_folder(spark, "stored")
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(at)
    with _FreedShuffles(spark):
        df.select("*").write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored_so_far(spark: SparkSession) -> int:
    """How many frames are stored and not released."""
    return len(_STORED.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, after: int = 0) -> None:
    """Delete the frames stored after the first `after` ones; frames that still read them are of no more use."""
    held = _STORED.get(spark.sparkContext.applicationId, [])
    while len(held) > after:
        remove(spark, held.pop())
