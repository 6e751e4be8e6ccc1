"""Frame sampling: which frames of a video are looked at, and when they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sampled_indices(total: Column, fps: Column, interval_seconds: float = 1.0, most: int = 300) -> Column:
    """Array of (ordinal, frame_index, timestamp_seconds, capped) of a video's sampled frames.

    A frame every interval; if that makes more than `most`, so many frames evenly over the video.
    Halves round to even.
    """
    step = F.greatest(F.lit(1.0), fps * interval_seconds)
    asked = F.ceil(total / step).cast("long")
    count = F.least(asked, F.lit(most).cast("long"))
    capped = asked > most

    def frame(i: Column) -> Column:
        even = F.rint(i * (total - 1) / (count - 1))
        index = F.when(capped & (count > 1), even).otherwise(F.least(F.rint(i * step), (total - 1).cast("double"))).cast("long")
        return F.struct(i.alias("ordinal"), index.alias("frame_index"), (index / fps).alias("timestamp_seconds"), capped.alias("capped"))

    return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), frame)


def sampled_frames(videos: DataFrame, *, interval_seconds: float = 1.0, most: int = 300) -> DataFrame:
    """Videos (…, total, fps) -> a row for each sampled frame: ordinal, frame_index, timestamp_seconds, capped."""
    return videos.select("*", F.inline(sampled_indices(F.col("total"), F.col("fps"), interval_seconds, most)))


def too_long(total: Column, fps: Column, most_seconds: float = 7200) -> Column:
    return total / fps > most_seconds


def even_indices(count: Column, most: int = 12) -> Column:
    """At most `most` indices from 0 to count - 1, evenly apart, cut towards zero."""
    k = F.least(count.cast("long"), F.lit(most))
    return F.when(k == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.floor(i * (count - 1) / (k - 1)).cast("long")))


def numbered(frames: DataFrame, video: str, order: str) -> DataFrame:
    """Frames with their index inside their video, from 0."""
    return frames.withColumn("frame_index", F.row_number().over(Window.partitionBy(video).orderBy(order)).cast("long") - 1)


def attach_scores(frames: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with their scores, one for one: a frame or a score without the other, or twice, is an error."""
    n, m = frames.count(), scores.count()
    joined = frames.join(scores, keys)
    if n != m or joined.count() != n or frames.select(*keys).distinct().count() != n:
        raise ValueError(f"{n} frames and {m} scores do not pair up")
    return joined
