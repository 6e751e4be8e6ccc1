"""Ingestion: content type by magic bytes, hashes, limits, names, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES = 524_288_000
#: Media types and the file extensions that they are stored under.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "video/mp4": ".mp4", "video/quicktime": ".mov"}


def media_type(content: Column) -> Column:
    """Type by the first bytes, never by name; null where none fits."""
    return (
        F.when(F.startswith(content, F.unhex(F.lit("FFD8FF"))), "image/jpeg")
        .when(F.startswith(content, F.unhex(F.lit("89504E470D0A1A0A"))), "image/png")
        .when((F.octet_length(content) >= 12) & (F.substring(content, 5, 4) == F.lit("ftyp").cast("binary")),
              F.when(F.substring(content, 9, 4) == F.lit("qt  ").cast("binary"), "video/quicktime").otherwise("video/mp4"))
    )


def reject_reason(size: Column, kind: Column, most: int = MAX_UPLOAD_BYTES) -> Column:
    """Why a file is refused, null if it isn't; the size is asked first."""
    return F.when(size == 0, "empty").when(size > most, "too_large").when(kind.isNull(), "unsupported_type")


def ingest(files: DataFrame, *, content: str = "content", most: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Adds media_type, sha256, size_bytes and reject_reason to rows of whole files."""
    c = F.col(content)
    size = F.octet_length(c).cast("long")
    return files.select("*", media_type(c).alias("media_type"), F.sha2(c, 256).alias("sha256"), size.alias("size_bytes")).withColumn(
        "reject_reason", reject_reason(F.col("size_bytes"), F.col("media_type"), most)
    )


def safe_name(name: Column) -> Column:
    """Last path segment; nothing, `.` and `..` become `unnamed`."""
    last = F.regexp_extract(F.regexp_replace(F.regexp_replace(name, r"(/\.)+/*$", ""), r"/+$", ""), r"([^/]*)$", 1)
    return F.when(last.isin("", ".", ".."), "unnamed").otherwise(last)


def extension(kind: Column) -> Column:
    pairs = [x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), kind)


def stored_name(job_id: Column, kind: Column) -> Column:
    """Name that an accepted file is kept under."""
    return F.concat(job_id, extension(kind))


def stays_inside(path: Column) -> Column:
    """Whether a relative path never leaves its root; absolute and drive paths do."""
    step = lambda a, s: F.struct(
        (a["depth"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("depth"),
        F.least(a["low"], a["depth"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("low"),
    )
    walked = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")), step)
    return ~F.startswith(path, F.lit("/")) & ~path.rlike(r"^[A-Za-z]:") & ~F.startswith(path, F.lit("\\")) & (walked["low"] >= 0)


def image_suffix(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(jpg|jpeg|png)$")


def within_pixels(width: Column, height: Column, most: int = 40_000_000) -> Column:
    return width.cast("long") * height <= most


def sound_header(fps: Column, frames: Column, width: Column, height: Column) -> Column:
    """Video header: finite positive rate, positive frames and size."""
    return (fps > 0) & ~F.isnan(fps) & (fps < float("inf")) & (frames > 0) & (width > 0) & (height > 0)


def accepted_by_client(mime: Column, name: Column, size: Column, most: int = MAX_UPLOAD_BYTES) -> Column:
    """MIME type or extension known, and not over the limit."""
    return (mime.isin(*EXTENSIONS) | F.lower(name).rlike(r"\.(jpg|jpeg|png|mp4|mov)$")) & (size <= most)


def verify_hashes(expected: DataFrame, files: DataFrame, *, key: str, content: str = "content") -> DataFrame:
    """expected (key, sha256) with the status of its file: ok, differs or read_error."""
    actual = files.select(F.col(key), F.sha2(F.col(content), 256).alias("_actual"))
    status = F.when(F.col("_actual").isNull(), "read_error").when(F.col("_actual") == F.col("sha256"), "ok").otherwise("differs")
    return expected.join(actual, key, "left").select(expected["*"], status.alias("status"))
