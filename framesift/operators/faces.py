"""Faces by a cascade that is a table: boxes as a column, and the cropper that face models are fed by."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cascade, pixels
from . import imaging

#: A cascade's rows: a stump each, in order of stage and stump.
STUMPS = "stage int, stage_threshold double, stump int, threshold double, low double, high double, rects array<struct<x:int,y:int,w:int,h:int,weight:double>>"
BOXES = "array<struct<x:int,y:int,w:int,h:int>>"
#: Stumps that a cascade may have: all of them go to every task.
MOST_STUMPS = 100_000


def cascade_of(stumps: DataFrame, width: int, height: int) -> cascade.Cascade:
    """The cascade of a table (STUMPS) for windows of that size; rectangles beyond the window are an error, as is a
    table without stumps."""
    rows = stumps.orderBy("stage", "stump").limit(MOST_STUMPS + 1).collect()
    if not rows or len(rows) > MOST_STUMPS:
        raise ValueError(f"1 to {MOST_STUMPS} stumps are wanted")
    stages: dict[int, tuple[float, list[cascade.Stump]]] = {}
    for r in rows:
        rects = tuple((q["x"], q["y"], q["w"], q["h"], q["weight"]) for q in r["rects"])
        if any(x < 0 or y < 0 or w < 1 or h < 1 or x + w > width or y + h > height for x, y, w, h, _ in rects):
            raise ValueError(f"stage {r['stage']}: a rectangle leaves the window")
        stages.setdefault(r["stage"], (r["stage_threshold"], []))[1].append(cascade.Stump(rects, r["threshold"], r["low"], r["high"]))
    return cascade.Cascade(width, height, tuple((t, tuple(s)) for t, s in stages.values()))


def boxes(image: Column, of: cascade.Cascade, *, scale: float = 1.1, neighbours: int = 5, least: int = 40) -> Column:
    """Struct of boxes (BOXES, largest first, empty if there are none) and error."""

    def kernel(rgb: np.ndarray) -> tuple:
        found = cascade.detected(pixels.gray(rgb), of, scale, neighbours, least)
        return ([dict(zip("xywh", b)) for b in found],)

    return imaging.per_image("boxes:array<struct<x:int,y:int,w:int,h:int>>", kernel)(image)


def cropper(of: cascade.Cascade, *, size: int = 512, margin: float = 1.5, **limits: float) -> Callable[[np.ndarray], np.ndarray | None]:
    """What video.face_scores and evaluate.scored_catalog take: the largest face of an image, or None."""

    def crop(rgb: np.ndarray) -> np.ndarray | None:
        found = cascade.detected(pixels.gray(rgb), of, **limits)
        return cascade.cropped(rgb, found[0], size, margin) if found else None

    return crop


def with_boxes(frames: DataFrame, of: cascade.Cascade, **limits: float) -> DataFrame:
    """frames (…, image) with face_boxes and face_error; frames without an image have neither."""
    found = frames.withColumn("_faces", boxes(F.col("image"), of, **limits))
    return found.select(*frames.columns, F.col("_faces.boxes").cast(BOXES).alias("face_boxes"), F.col("_faces.error").alias("face_error"))
