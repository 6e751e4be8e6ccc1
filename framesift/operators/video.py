"""Frames of videos by a decoder that is a plug-in, and scores of the faces in them.

A decoder's frame(content, index) gives an image as rows of red, green, blue, or None where it can't. A
cropper gives the face of an image or None; a model is what scoring.predict takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoint import cut
from . import imaging, sampling, scoring


class Decoder(Protocol):
    def frame(self, content: bytes, index: int) -> np.ndarray | None: ...


FRAMES = f"ordinal int, frame_index long, timestamp_seconds double, image {imaging.IMAGE}"
FACES = "struct<candidate_frames:long,analysed_faces:long,probability:double,top_frame:long,frame_scores:array<struct<frame_index:long,timestamp_seconds:double,probability:double>>>"


def as_image(rgb: np.ndarray) -> dict:
    return {"height": rgb.shape[0], "width": rgb.shape[1], "channels": 3, "data": np.ascontiguousarray(rgb[..., ::-1], np.uint8).tobytes()}


def decoded_frames(media: DataFrame, decoder: Decoder | None, *, interval_seconds: float = 1.0, most: int = 300) -> DataFrame:
    """Inspected videos (job_id, media_type, content, header, decode_reject) -> job_id, FRAMES.

    Frames that can't be decoded are left out, and the ordinals count what is left. A video's content goes
    to its decoder once, whatever the number of frames. Without a decoder there are none.
    """
    kind = media.schema["job_id"].dataType.simpleString()
    schema = f"job_id {kind}, {FRAMES}"
    if decoder is None:
        return media.sparkSession.createDataFrame([], schema)
    asked = sampling.sampled_indices(F.col("header.frame_count"), F.col("header.frame_rate"), interval_seconds, most)
    films = media.filter(F.startswith("media_type", F.lit("video/")) & F.col("decode_reject").isNull()).select("job_id", "content", asked.alias("asked"))

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                done = []
                for want in row.asked:
                    rgb = decoder.frame(bytes(row.content), int(want["frame_index"]))
                    if rgb is not None:
                        done.append((row.job_id, len(done), int(want["frame_index"]), round(float(want["timestamp_seconds"]), 3), as_image(rgb)))
                yield pd.DataFrame(done, columns=["job_id", "ordinal", "frame_index", "timestamp_seconds", "image"])

    return films.mapInPandas(decode, schema)


def all_frames(media: DataFrame, decoder: Decoder | None, **options: float) -> DataFrame:
    """Frames of videos, and of each decoded still (image is not null) itself as its one frame."""
    still = media.filter(F.startswith("media_type", F.lit("image/")) & F.col("image").isNotNull())
    one = still.select("job_id", F.lit(0).alias("ordinal"), F.lit(0).cast("long").alias("frame_index"), F.lit(0.0).alias("timestamp_seconds"), "image")
    return one.unionByName(decoded_frames(media, decoder, **options))


def face_scores(frames: DataFrame, cropper: Callable[[np.ndarray], np.ndarray | None] | None, model: Callable | None, *, batch: int = 4) -> DataFrame:
    """frames (job_id, frame_index, timestamp_seconds, image) -> job_id, faces (FACES).

    The probability of a job with one frame is its face's; of more, the softmax-weighted score. Jobs without
    a face have a null probability; without a cropper or a model there are no rows, never made-up scores.
    """
    if cropper is None or model is None:
        return frames.sparkSession.createDataFrame([], f"job_id {frames.schema['job_id'].dataType.simpleString()}, faces {FACES}")

    def crop(rgb: np.ndarray) -> tuple:
        face = cropper(rgb)
        return (None if face is None else np.asarray(face, float).ravel().tolist(),)

    found = frames.select("job_id", "frame_index", "timestamp_seconds", imaging.per_image("face:array<double>", crop)(F.col("image"))["face"].alias("face"))
    # Scores are narrow; cut, they are what all that follows reads, so each face is scored once.
    scored = cut(scoring.predict(found.filter("face IS NOT NULL"), model, features="face", batch=batch).drop("face"))
    total = frames.groupBy("job_id").agg(F.count("*").alias("candidate_frames"))
    rows = F.array_sort(F.collect_list(F.struct("frame_index", "timestamp_seconds", "probability")))  # at most the sampled frames of a video
    faces = scored.groupBy("job_id").agg(F.count("*").alias("analysed_faces"), rows.alias("frame_scores"))
    video = scoring.video_scores(scored, "job_id", "probability")
    top = scoring.top_frame(scored, "job_id", "probability", "frame_index").select("job_id", F.col("frame_index").alias("top_frame"))
    joined = total.join(faces, "job_id", "left").join(video, "job_id", "left").join(top, "job_id", "left")
    probability = F.when(F.col("candidate_frames") == 1, F.get("frame_scores", F.lit(0))["probability"]).otherwise(F.col("video_score"))
    told = F.struct("candidate_frames", F.coalesce("analysed_faces", F.lit(0)).cast("long").alias("analysed_faces"), probability.alias("probability"), "top_frame", "frame_scores")
    return joined.select("job_id", told.cast(FACES).alias("faces"))
