"""Signals of decoded images as columns: low bits, hidden payloads, recompression error, residuals, spectra.

An image is a struct of height, width, channels and data (blue, green, red by row), as Spark's image source
decodes it. Kernels run in Arrow batches; one that fails for an image says so in `error` and no other row
is touched. A codec is codec(rgb, quality) -> rgb after lossy coding; the library's own is dct.recoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions import dct, pixels, png
from . import forensics

IMAGE = "struct<height:int,width:int,channels:int,data:binary>"
CHANNELS = ("red", "green", "blue")
#: Bytes of the packed low bits that leave the kernel: all that a payload and its layout can take.
STREAM_HEAD = forensics.MOST_PAYLOAD + 128
QUALITY, THRESHOLD = 90, 20
#: Rows of a batch that are Python objects at once.
SLICE = 64
#: Colour of outlines.
MARKED = (220, 38, 38)
Codec = Callable[[np.ndarray, int], np.ndarray]


def rgb_of(image: dict) -> np.ndarray:
    x = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["channels"])
    return x[..., [2, 1, 0]] if image["channels"] >= 3 else np.repeat(x[..., :1], 3, axis=2)


def per_image(schema: str, kernel: Callable[..., tuple]) -> Callable[..., Column]:
    """UDF over images and further columns -> struct of the kernel's values and `error`; null for no image.

    Told as not deterministic, so that a filter on what it gives is not pushed below it, where each image would be
    looked at twice, by two workers; where several values are taken, it is made a column first.
    Of a batch only SLICE rows at a time are Python objects, so a worker's memory follows these, not the batch.
    """
    names = [part.split(":")[0] for part in schema.split(";")]
    fields = f"struct<{','.join(schema.split(';'))},error:string>"
    kind = to_arrow_type(DataType.fromDDL(fields))

    def row(image: dict | None, others: tuple) -> dict:
        values, error = (None,) * len(names), None
        if image is not None and image["data"] is not None:
            try:
                values = kernel(rgb_of(image), *others)
            except Exception as failure:  # noqa: BLE001  one image's failure is its result
                error = f"{type(failure).__name__}: {failure}"
        return {**dict(zip(names, values)), "error": error}

    @F.arrow_udf(fields)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            for at in range(0, len(columns[0]), SLICE):
                images, *others = (c.slice(at, SLICE).to_pylist() for c in columns)
                yield pa.array([row(*x) for x in zip(images, zip(*others) if others else [()] * len(images))], kind)

    once = run.asNondeterministic()
    return lambda image, *others: F.when(image.isNotNull(), once(image, *others))


def face_scores(image: Column, cropper: Callable, model: Callable, *, batch: int = 4) -> Column:
    """What a model says of each image's face; null for no image, or one whose face is not found or can't be cropped.

    cropper: rgb -> face or None; model: loads once a worker and maps lists of flat faces, up to `batch` of them, to
    numbers. One worker crops and scores, so no face leaves it; of a batch only SLICE rows are Python objects at once.
    """

    def face(image: dict | None) -> np.ndarray | None:
        try:
            found = None if image is None or image["data"] is None else cropper(rgb_of(image))
            return None if found is None else np.asarray(found, float).ravel()
        except Exception:  # noqa: BLE001  one image's failure is its result
            return None

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        told = model()
        for images in batches:
            for at in range(0, len(images), SLICE):
                faces = [face(x) for x in images.slice(at, SLICE).to_pylist()]
                seen, out = [i for i, x in enumerate(faces) if x is not None], [None] * len(faces)
                for k in range(0, len(seen), batch):
                    some = seen[k : k + batch]
                    for i, score in zip(some, told([faces[i] for i in some]), strict=True):
                        out[i] = score
                yield pa.array(out, pa.float64())

    return run.asNondeterministic()(image)


def low_bits(image: Column) -> Column:
    """Struct of bits, ones_ratio and pair_imbalance by red, green, blue, head (first bytes of the packed low
    bits), entropy of the first 64 KiB of them, and error."""

    def kernel(rgb: np.ndarray) -> tuple:
        ones, pairs = zip(*pixels.lsb_statistics(rgb))
        stream = pixels.lsb_stream(rgb)
        n = np.bincount(np.frombuffer(stream[: forensics.MOST_PAYLOAD], np.uint8), minlength=256)
        p = n[n > 0] / n.sum()
        return int(rgb.size), [float(x) for x in ones], [float(x) for x in pairs], stream[:STREAM_HEAD], float(max(0.0, -(p * np.log2(p)).sum()))

    return per_image("bits:long;ones_ratio:array<double>;pair_imbalance:array<double>;head:binary;entropy:double", kernel)(image)


def recompression(image: Column, codec: Codec = dct.recoded, quality: int = QUALITY, threshold: int = THRESHOLD, region: Column | None = None) -> Column:
    """Struct of mean_error, p95_error, max_error, highlighted_ratio, heatmap (red, green, blue by row), error.

    With a region (x0, y0, x1, y1; null for none) also region_mean and background_mean, as region_means gives them, by the
    worker that coded the image; a region that can't be taken leaves these two null and the rest as it is.
    """
    if not 1 <= quality <= 100:
        raise ValueError("quality must lie in 1..100")

    def kernel(rgb: np.ndarray, *box: list | None) -> tuple:
        again = codec(rgb, quality)
        mean, p95, most, share = pixels.error_summary(pixels.error_levels(rgb, again), threshold)
        heat, means = pixels.heatmap(rgb, again), ()
        if box:
            try:
                means = _means(heat, box[0])
            except Exception:  # noqa: BLE001  one region's failure is not its image's
                means = (None, None)
        return mean, p95, most, share, heat.tobytes(), *means

    schema = "mean_error:double;p95_error:double;max_error:int;highlighted_ratio:double;heatmap:binary"
    return per_image(schema, kernel)(image) if region is None else per_image(f"{schema};region_mean:double;background_mean:double", kernel)(image, region)


def _means(heat: np.ndarray, box: list | None) -> tuple[float | None, float | None]:
    """Mean of a heatmap's brightest channel inside a box, and outside it."""
    if box is None:
        return None, None
    x0, y0, x1, y1 = (int(v) for v in box)
    level = heat.max(axis=2).astype(float)
    inside = np.zeros(level.shape, bool)
    inside[y0:y1, x0:x1] = True
    mean = lambda v: float(v.mean()) if v.size else None
    return mean(level[inside]), mean(level[~inside])


def region_means(image: Column, heatmap: Column, region: Column) -> Column:
    """Struct of region_mean and background_mean of a heatmap's brightest channel; region: x0, y0, x1, y1.

    For heatmaps that are stored; where the image is coded in the same plan, recompression takes the region itself.
    """

    def kernel(rgb: np.ndarray, heat: bytes | None, box: list | None) -> tuple:
        return (None, None) if heat is None else _means(np.frombuffer(heat, np.uint8).reshape(rgb.shape), box)

    return per_image("region_mean:double;background_mean:double", kernel)(image, heatmap, region)


def keyed_payload(image: Column, seed: Column, size: Column) -> Column:
    """Struct of payload and error: bytes hidden in an order that the seed gives."""
    return per_image("payload:binary", lambda rgb, s, n: (pixels.keyed_payload(rgb, int(s), int(n)),))(image, seed, size)


def residuals(image: Column) -> Column:
    """Struct of levels (mean absolute value of each of the nine high-pass maps), map (their mean by pixel,
    stretched to 0..255, as bytes) and error."""

    def kernel(rgb: np.ndarray) -> tuple:
        maps = np.abs(pixels.residual_maps(rgb))
        return maps.mean(axis=(1, 2)).tolist(), _shown(maps.mean(axis=0))

    return per_image("levels:array<double>;map:binary", kernel)(image)


def spectra(image: Column, maps: int = 10) -> Column:
    """Struct of levels (mean of each magnitude and phase map of the residuals' spectra), map (mean of the
    first ones by pixel, stretched to 0..255, as bytes) and error."""

    def kernel(rgb: np.ndarray) -> tuple:
        found = pixels.spectrum_maps(pixels.residual_maps(rgb))
        return found.mean(axis=(1, 2)).tolist(), _shown(found[:maps].mean(axis=0))

    return per_image("levels:array<double>;map:binary", kernel)(image)


def prediction_errors(image: Column, weights: np.ndarray) -> Column:
    """Struct of levels (mean absolute value of each constrained kernel's maps over red, green, blue) and error."""
    kernels = pixels.constrained(weights)
    return per_image("levels:array<double>", lambda rgb: (np.abs(pixels.convolved(np.moveaxis(rgb / 255.0, 2, 0), kernels)).mean(axis=(1, 2)).tolist(),))(image)


def _shown(values: np.ndarray) -> bytes:
    span = max(float(values.max() - values.min()), 1e-6)
    return ((values - values.min()) / span * 255).astype(np.uint8).tobytes()


def as_png(image: Column, rgb: Column | None = None) -> Column:
    """Struct of png, the image as a file, and error; rgb: other bytes (red, green, blue by row) of the same size, such as a heatmap."""
    return per_image("png:binary", lambda x, other: (None if other is None else png.encoded(np.frombuffer(other, np.uint8).reshape(x.shape)),))(image, rgb) if rgb is not None else per_image(
        "png:binary", lambda x: (png.encoded(np.ascontiguousarray(x)),)
    )(image)


def with_box(image: Column, box: Column, colour: tuple[int, int, int] = MARKED, thick: int = 3) -> Column:
    """Struct of png, the image with the outline of a box (x, y, w, h), and error; without a box there is no file."""

    def kernel(rgb: np.ndarray, at: dict | None) -> tuple:
        if at is None:
            return (None,)
        x, y, w, h = (int(at[k]) for k in "xywh")
        return (png.encoded(pixels.outlined(rgb, x, y, x + w - 1, y + h - 1, colour, thick)),)

    return per_image("png:binary", kernel)(image, box)
