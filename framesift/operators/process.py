"""Processing of queued jobs: integrity, inspection, analyzers, one result and one ledger change for each."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoint import cut, stored
from ..sources import media as sources
from . import analyzers, headers, ingest, jobs, video, watermark

INGESTION = "platform_ingestion"
MOST_ERROR = 1000
#: Allowed steps of a job's status.
STEPS = {"queued": ("processing", "failed"), "processing": ("completed", "partially_completed", "failed")}


@dataclasses.dataclass(frozen=True)
class Settings:
    """Limits of ingestion and sampling; every number has to be positive. from_environment reads FRAMESIFT_<NAME>."""

    max_upload_bytes: int = ingest.MAX_UPLOAD_BYTES
    max_pixels: int = 40_000_000
    max_seconds: float = 7200
    interval_seconds: float = 1.0
    max_frames: int = 300
    retention_hours: float = 168
    cleanup_interval_seconds: float = 3600

    def __post_init__(self) -> None:
        for field in dataclasses.fields(self):
            if not getattr(self, field.name) > 0:
                raise ValueError(f"{field.name} must be positive")

    @classmethod
    def from_environment(cls) -> Settings:
        given = {f.name: os.environ[name] for f in dataclasses.fields(cls) if (name := f"FRAMESIFT_{f.name.upper()}") in os.environ}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items()})


def new_job_ids(uploads: DataFrame) -> DataFrame:
    """Uploads with a random id each; written once, as a retried task draws others."""
    return uploads.withColumn("id", F.uuid())


def allowed_step(before: Column, after: Column) -> Column:
    """Whether a job may go from one status to another."""
    return F.coalesce(*[F.when(before == b, after.isin(*a)) for b, a in STEPS.items()], F.lit(False))


def prepared(files: DataFrame, decoded: DataFrame, settings: Settings, decoder: video.Decoder | None = None, cropper: Callable | None = None, model: Callable | None = None) -> DataFrame:
    """files (job_id, path, content) -> media with type, header, image, watermark and faces, where these can be had.

    Frames are decoded once and stored; what is found in them is narrow and cut, so that neither a frame nor a face is
    looked at again, and contents only meet findings, not frames.
    """
    typed = headers.inspected(ingest.ingest(files, most=settings.max_upload_bytes), most_pixels=settings.max_pixels, most_seconds=settings.max_seconds)
    media = sources.with_images(typed, decoded)
    frames = video.all_frames(media, decoder, interval_seconds=settings.interval_seconds, most=settings.max_frames)
    if decoder is not None:
        frames = stored(frames)
    found = frames.groupBy("job_id").agg(F.count("*").alias("sampled_frames"))
    for more in (watermark.visible_marks(frames), video.face_scores(frames, cropper, model)):
        found = found.join(more, "job_id", "left")
    return media.join(cut(found), "job_id", "left")


def process(queued: DataFrame, files: DataFrame, decoded: DataFrame, now: Column, *, settings: Settings | None = None, registry: Sequence[analyzers.Analyzer] | None = None,
            decoder: video.Decoder | None = None, cropper: Callable | None = None, model: Callable | None = None) -> DataFrame:
    """queued (id, source_path, sha256) and files (path, content) -> changes for jobs.update: id, status,
    updated_at, error, result.

    A job whose file is missing, differs from its hash, or can't be looked into has failed, with the reason;
    any other has a result of all modules in order, ingestion first, and is completed if all of these are.
    """
    settings = settings or Settings()
    of_job = files.join(queued.select(F.col("id").alias("job_id"), F.col("source_path").alias("path")), "path").select("job_id", "path", "content")
    media = prepared(of_job, decoded, settings, decoder, cropper, model)
    checked = ingest.verify_hashes(queued.select(F.col("id").alias("job_id"), F.col("sha256")), of_job, key="job_id").select("job_id", F.col("status").alias("integrity"))
    wrong = (
        F.when(F.col("integrity") == "read_error", "file could not be read").when(F.col("integrity") == "differs", "file differs from its stored hash")
        .otherwise(F.coalesce(F.col("reject_reason"), F.col("decode_reject")))
    )
    state = checked.join(media.select("job_id", "reject_reason", "decode_reject", "sampled_frames"), "job_id", "left").select("job_id", "sampled_frames", F.substring(wrong, 1, MOST_ERROR).alias("error"))
    results = analyzers.analyse(media, registry)
    taken = analyzers.result(INGESTION, F.lit("completed"), F.to_json(F.struct(F.lit(True).alias("sha256_verified"), F.coalesce("sampled_frames", F.lit(0)).alias("sampled_frame_count"))), F.array())
    told = state.join(results, "job_id", "left").withColumn("modules", F.concat(F.array(taken), F.coalesce("modules", F.array().cast(f"array<{analyzers.MODULE}>"))))
    shown = F.transform("modules", lambda m: m.withField("artifacts", F.transform(m["artifacts"], lambda a: F.struct(a["kind"].alias("kind"), a["name"].alias("name")))))
    body = F.to_json(F.struct(shown.alias("modules")), {"ignoreNullFields": "false"})
    ok = F.col("error").isNull()
    return told.select(F.col("job_id").alias("id"), F.when(ok, jobs.status_of(F.col("modules"))).otherwise("failed").alias("status"), now.alias("updated_at"), "error", F.when(ok, body).alias("result"))
