"""Visible generator marks: a four-pointed star that stays in a corner of an image or of a video's frames.

Frames -> at most FRAMES of each job, spread evenly -> one evidence map a job (the median of what is brighter
than its surroundings) -> every corner and template size as an array of tries -> the best of them, the
earliest on a tie -> a decision. Only the two array kernels run outside Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pixels
from . import imaging, sampling

# Frames and edge length looked at, corner regions as shares of width and height (left, top,
# right, bottom), template sizes in pixels, and the scores that are enough.
FRAMES, EDGE = 12, 1280
CORNERS = {"top_left": (0.0, 0.0, 0.35, 0.45), "top_right": (0.65, 0.0, 1.0, 0.45), "bottom_left": (0.0, 0.55, 0.35, 1.0), "bottom_right": (0.65, 0.55, 1.0, 1.0)}
MARKED = "bottom_right"
SCALES, SHARE, LEAST_BASE, LEAST_SIZE, MOST_SIZE = (0.7, 0.8, 0.9, 1.0, 1.1, 1.25, 1.5, 1.75, 2.0), 0.075, 24, 18, 96
ENOUGH, ENOUGH_ALONE, SEVERAL = 0.60, 0.88, 3

RESULT = "struct<found:boolean,score:double,location:string,box:struct<x:int,y:int,w:int,h:int>,frames:int>"


def chosen(frames: DataFrame) -> DataFrame:
    """frames (job_id, frame_index, image) -> at most FRAMES of each job, chosen by their indices alone: no image is sorted."""
    of_job = Window.partitionBy("job_id")
    numbered = frames.select("job_id", "frame_index").withColumn("_n", F.count("*").over(of_job)).withColumn("_i", F.row_number().over(of_job.orderBy("frame_index")) - 1)
    picked = numbered.filter(F.array_contains(sampling.even_indices(F.col("_n"), FRAMES), F.col("_i").cast("long"))).drop("_n", "_i")
    return frames.join(picked, ["job_id", "frame_index"], "left_semi")


def evidence(frames: DataFrame) -> DataFrame:
    """Chosen frames -> job_id, frames, height, width, map: undecodable frames are left out, and a job without
    any other has no row. Frames are scaled to EDGE at most and to the first one's size."""

    def median(part: pd.DataFrame) -> pd.DataFrame:
        planes: list[np.ndarray] = []
        for image in part.sort_values("frame_index").image:
            if image is None or image["data"] is None:
                continue
            plane = pixels.gray(imaging.rgb_of(image))
            shrink = min(1.0, EDGE / max(plane.shape))
            size = planes[0].shape if planes else tuple(max(1, round(n * shrink)) for n in plane.shape)
            planes.append(pixels.bright_contrast(np.rint(pixels.resized(plane, *size))))
        if not planes:
            return pd.DataFrame(columns=["job_id", "frames", "height", "width", "map"])
        middle = np.median(np.stack(planes), axis=0).astype(np.uint8)
        return pd.DataFrame([(part.job_id.iloc[0], len(planes), *middle.shape, middle.tobytes())], columns=["job_id", "frames", "height", "width", "map"])

    kind = frames.schema["job_id"].dataType.simpleString()
    return frames.select("job_id", "frame_index", "image").groupBy("job_id").applyInPandas(median, f"job_id {kind}, frames int, height int, width int, map binary")


def tries(height: Column, width: Column) -> Column:
    """Array of (corner, x0, y0, x1, y1, size): each size that fits, corner by corner."""
    share = lambda of, part: F.floor(of * part).cast("int")
    regions = F.array(*[
        F.struct(F.lit(name).alias("corner"), share(width, a).alias("x0"), share(height, b).alias("y0"), share(width, c).alias("x1"), share(height, d).alias("y1"))
        for name, (a, b, c, d) in CORNERS.items()
    ])
    base = F.greatest(F.lit(LEAST_BASE), F.least(F.lit(MOST_SIZE), F.rint(F.least(height, width) * SHARE)))
    sizes = F.array_sort(F.array_distinct(F.array(*[F.least(F.lit(MOST_SIZE), F.greatest(F.lit(LEAST_SIZE), F.rint(base * s))).cast("int") for s in SCALES])))
    pairs = F.flatten(F.transform(regions, lambda r: F.transform(sizes, lambda n: F.struct(*[r[k].alias(k) for k in ("corner", "x0", "y0", "x1", "y1")], n.alias("size")))))
    return F.filter(pairs, lambda t: (t["x1"] - t["x0"] >= t["size"]) & (t["y1"] - t["y0"] >= t["size"]))


def _correlated(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The template's best place in each try."""
    for maps, heights, widths, asked in parts:
        out = []
        for data, height, width, each in zip(maps, heights, widths, asked):
            plane, found = np.frombuffer(data, np.uint8).reshape(height, width).astype(float), []
            for t in each:
                scores = pixels.correlation(plane[t["y0"] : t["y1"], t["x0"] : t["x1"]], pixels.star_template(t["size"]))
                y, x = np.unravel_index(int(scores.argmax()), scores.shape)
                found.append({"score": float(scores[y, x]), "x": int(x) + t["x0"], "y": int(y) + t["y0"]})
            out.append(found)
        yield pd.Series(out)


def best_match(maps: DataFrame) -> DataFrame:
    """Evidence -> job_id, frames, score, corner, box of the best try over all corners; 0 and null if none is above 0."""
    tried = maps.select("job_id", "frames", "map", "height", "width", tries(F.col("height"), F.col("width")).alias("tries"))
    told = tried.select("job_id", "frames", "tries", F.pandas_udf(_correlated, "array<struct<score:double,x:int,y:int>>")("map", "height", "width", "tries").alias("at"))
    ranked = F.transform("at", lambda a, i: F.struct(a["score"].alias("score"), (-i).alias("earlier"), a.alias("at"), F.get("tries", i).alias("try")))
    top = told.select("job_id", "frames", F.array_max(F.filter(ranked, lambda r: r["score"] > 0)).alias("top"))
    box = F.struct(F.col("top.at.x").alias("x"), F.col("top.at.y").alias("y"), F.col("top.try.size").alias("w"), F.col("top.try.size").alias("h"))
    return top.select("job_id", "frames", F.coalesce("top.score", F.lit(0.0)).alias("score"), F.col("top.try.corner").alias("corner"), F.when(F.col("top").isNotNull(), box).alias("box"))


def visible_marks(frames: DataFrame) -> DataFrame:
    """frames (job_id, frame_index, image) -> job_id, watermark (RESULT); jobs without a decodable frame have no row.

    The best match over all corners has to lie in the marked one, so a stronger one elsewhere is no mark. The
    score is told either way, its place only with a mark.
    """
    best = best_match(evidence(chosen(frames)))
    found = (F.col("score") >= F.when(F.col("frames") >= SEVERAL, ENOUGH).otherwise(ENOUGH_ALONE)) & F.coalesce(F.col("corner") == MARKED, F.lit(False))
    result = F.struct(found.alias("found"), F.round("score", 6).alias("score"), F.when(found, F.col("corner")).alias("location"), F.when(found, F.col("box")).alias("box"), F.col("frames").alias("frames"))
    return best.select("job_id", result.cast(RESULT).alias("watermark"))
