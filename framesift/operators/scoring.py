"""Scores: calibrated probability, softmax-weighted video score, decisions, face boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPERATURE = 0.1


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def calibrated(logit: Column, temperature: float) -> Column:
    return 1 / (1 + F.exp(-logit / max(temperature, 1e-6)))


def video_scores(frames: DataFrame, key: str, score: str, temperature: float = TEMPERATURE) -> DataFrame:
    """key, video_score: mean of clipped scores weighted by exp((score - largest) / temperature).

    Two grouped aggregations with map-side combine; no window over a video's frames.
    """
    t = max(temperature, 1e-8)
    clipped = frames.select(key, clip01(F.col(score)).alias("_v"))
    # exp(-1 / t) keeps the weights finite, so the shift by the largest score can be the constant 1.
    weight = F.exp((F.col("_v") - 1) / t)
    if t < 0.01:
        clipped = clipped.join(clipped.groupBy(key).agg(F.max("_v").alias("_m")), key)
        weight = F.exp((F.col("_v") - F.col("_m")) / t)
    return clipped.groupBy(key).agg((F.sum(F.col("_v") * weight) / F.sum(weight)).alias("video_score"))


def top_frame(frames: DataFrame, key: str, score: str, index: str) -> DataFrame:
    """First frame of the highest score."""
    best = F.max(F.struct(F.col(score), (-F.col(index)).alias("_neg")))
    return frames.groupBy(key).agg(best.alias("_best")).select(key, (-F.col("_best._neg")).alias(index), F.col(f"_best.{score}").alias(score))


def coverage(faces: Column, candidates: Column) -> Column:
    return F.when(candidates > 0, faces / candidates).otherwise(0.0)


def decision(score: Column, threshold: float, validated: bool) -> Column:
    if not validated:
        return F.lit("evaluation_pending")
    return F.when(score >= threshold, "suspicious").otherwise("lower_risk")


def assessment(watermark: Column, claim: Column) -> Column:
    return F.when(watermark, "strong_ai_origin_evidence").when(claim, "unverified_ai_origin_claim").otherwise("inconclusive")


def largest_box(boxes: Column) -> Column:
    """First of the boxes (x, y, w, h) of largest area."""
    return F.array_max(F.transform(boxes, lambda b, i: F.struct((b["w"] * b["h"]).alias("area"), (-i).alias("first"), b.alias("box"))))["box"]


def crop_box(box: Column, width: Column, height: Column, margin: float = 1.5) -> Column:
    """Square of `margin` times the longer side around a box's centre, cut to the image; each edge's halves to even."""
    half = F.greatest(box["w"], box["h"]) * margin / 2
    x, y = box["x"] + box["w"] / 2, box["y"] + box["h"] / 2
    x0, y0 = F.greatest(F.rint(x - half), F.lit(0.0)), F.greatest(F.rint(y - half), F.lit(0.0))
    x1, y1 = F.least(F.rint(x + half), width.cast("double")), F.least(F.rint(y + half), height.cast("double"))
    return F.struct(*[v.cast("int").alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def predict(frames: DataFrame, model: Callable | None, *, features: str, batch: int = 4) -> DataFrame:
    """Adds probability and status. model: loads once a worker and maps arrays of features to logits.

    Without a model every row is skipped, never scored.
    """
    if model is None:
        return frames.select("*", F.lit(None).cast("double").alias("probability"), F.lit("skipped").alias("status"))

    whole = max(1, 256 // batch) * batch  # rows that are Python objects at once

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = model()
        for part in parts:
            for at in range(0, len(part), whole):
                out: list[float] = []
                some = [np.asarray(x) if isinstance(x, list) else x for x in part.slice(at, whole).to_pylist()]
                for i in range(0, len(some), batch):
                    out += list(run(some[i : i + batch]))
                yield pa.array(out, pa.float64())

    return frames.select("*", scored(F.col(features)).alias("probability"), F.lit("completed").alias("status"))
