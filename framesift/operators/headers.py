"""Headers of stills and videos as columns: format, size, mode, tags, frame rate, frames, codec.

Only headers are read (PNG chunks, JPEG segments, the boxes of MP4 and QuickTime), never pixels. What can't
be read is a warning of its row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from . import ingest, sampling

HEADER = "struct<format:string,mode:string,width:int,height:int,frame_rate:double,frame_count:long,fourcc:long,exif:map<string,string>,parser_warning:string>"
MOST_TAGS, MOST_TEXT, MOST_BYTES = 100, 500, 64
# Names of image tags by their number.
TAGS = {
    256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 270: "ImageDescription", 271: "Make", 272: "Model",
    274: "Orientation", 277: "SamplesPerPixel", 282: "XResolution", 283: "YResolution", 296: "ResolutionUnit", 305: "Software", 306: "DateTime", 315: "Artist",
    316: "HostComputer", 318: "WhitePoint", 319: "PrimaryChromaticities", 529: "YCbCrCoefficients", 531: "YCbCrPositioning", 532: "ReferenceBlackWhite",
    700: "XMLPacket", 33432: "Copyright", 34665: "ExifOffset", 34853: "GPSInfo", 40091: "XPTitle", 40092: "XPComment", 40093: "XPAuthor", 40094: "XPKeywords", 40095: "XPSubject",
}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}


def tags(tiff: bytes) -> dict[str, str]:
    """First tags of an image's tag directory: texts cut, bytes as hexadecimal digits, other values as text."""
    order = {b"II": "<", b"MM": ">"}[tiff[:2]]
    at = struct.unpack_from(order + "I", tiff, 4)[0]
    found = {}
    for k in range(min(MOST_TAGS, struct.unpack_from(order + "H", tiff, at)[0])):
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        size = _SIZES.get(kind, 0) * n
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", tiff, at + 10 + 12 * k)[0]
        raw = tiff[place : place + size]
        if kind == 2:
            value = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (1, 7):
            value = raw[:MOST_BYTES].hex() + ("..." if len(raw) > MOST_BYTES else "")
        else:
            code = _CODES.get(kind, "i" if kind == 10 else "I")
            values = struct.unpack_from(f"{order}{size // struct.calcsize(code)}{code}", raw)
            if kind in (5, 10):
                values = tuple(a / b if b else float("nan") for a, b in zip(values[::2], values[1::2]))
            value = str(values[0] if len(values) == 1 else values)[:MOST_TEXT]
        found[TAGS.get(tag, str(tag))] = value
    return found


def png(data: bytes) -> dict:
    width, height, depth, colour = struct.unpack_from(">IIBB", data, 16)
    out = {"format": "PNG", "mode": "1" if depth == 1 and not colour else _PNG_MODES[colour], "width": width, "height": height, "exif": {}}
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"eXIf":
            out["exif"] = tags(data[at + 8 : at + 8 + size])
        at += size + 12
    return out


def jpeg(data: bytes) -> dict:
    out, at = {"format": "JPEG", "exif": {}}, 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            out["exif"] = tags(data[at + 10 : at + 2 + size])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width, channels = struct.unpack_from(">HHB", data, at + 5)
            return {**out, "width": width, "height": height, "mode": {1: "L", 3: "RGB", 4: "CMYK"}[channels]}
        at += size + 2
    raise ValueError("no frame header")


def _boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or end - start
        if size < head:
            return
        yield kind, start + head, min(end, start + size)
        start += size


def video(data: bytes) -> dict:
    """The first video track's header."""

    def inside(kind: bytes, start: int, end: int) -> tuple[int, int]:
        return next((s, e) for k, s, e in _boxes(data, start, end) if k == kind)

    for kind, start, end in _boxes(data, *inside(b"moov", 0, len(data))):
        if kind != b"trak":
            continue
        media = inside(b"mdia", start, end)
        if data[inside(b"hdlr", *media)[0] + 8 :][:4] != b"vide":
            continue
        at = inside(b"mdhd", *media)[0]
        scale, length = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        samples = inside(b"stbl", *inside(b"minf", *media))
        entry = inside(b"stsd", *samples)[0] + 8
        width, height = struct.unpack_from(">HH", data, entry + 32)
        at = inside(b"stts", *samples)[0]
        frames = sum(struct.unpack_from(">I", data, at + 8 + 8 * k)[0] for k in range(struct.unpack_from(">I", data, at + 4)[0]))
        return {"format": "MP4", "width": width, "height": height, "frame_count": frames, "frame_rate": frames * scale / length if length else None, "fourcc": int.from_bytes(data[entry + 4 : entry + 8], "little")}
    raise ValueError("no video track")


_READERS = {"image/png": png, "image/jpeg": jpeg, "video/mp4": video, "video/quicktime": video}


def header(content: Column, kind: Column) -> Column:
    """Header struct of whole files by their media type; the warning says what could not be read."""
    return F.pandas_udf(_headers, HEADER)(content, kind)


def _headers(contents: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    names = [part.split(":")[0] for part in HEADER[7:-1].replace("map<string,string>", "map").split(",")]
    rows = []
    for content, kind in zip(contents, kinds):
        found: dict = {}
        if content is not None and kind in _READERS:
            try:
                found = _READERS[kind](bytes(content))
            except Exception:  # noqa: BLE001  a broken file is its row's warning
                found = {"parser_warning": "header could not be decoded"}
        rows.append([found.get(n) for n in names])
    return pd.DataFrame(rows, columns=names, dtype=object)


def inspected(media: DataFrame, *, most_pixels: int = 40_000_000, most_seconds: float = 7200) -> DataFrame:
    """media (…, media_type, content) with `header` and `decode_reject`: why a file is not looked into, or null."""
    found = media.withColumn("header", header(F.col("content"), F.col("media_type")))
    h, still = F.col("header"), F.startswith("media_type", F.lit("image/"))
    rate = F.coalesce(h["frame_rate"], F.lit(float("nan")))
    sound = F.when(still, (h["width"] > 0) & (h["height"] > 0)).otherwise(ingest.sound_header(rate, h["frame_count"], h["width"], h["height"]))
    reject = (
        F.when(h["parser_warning"].isNotNull() | ~F.coalesce(sound, F.lit(False)), "unreadable").when(~ingest.within_pixels(h["width"], h["height"], most_pixels), "too_many_pixels")
        .when(~still & sampling.too_long(h["frame_count"], rate, most_seconds), "too_long")
    )
    return found.withColumn("decode_reject", reject)


def metadata(head: Column, still: Column) -> Column:
    """JSON of what a report says of a header."""
    image = F.to_json(F.struct(*[head[k].alias(k) for k in ("format", "mode", "width", "height", "exif")]), {"ignoreNullFields": "false"})
    film = F.to_json(F.struct(head["width"].alias("width"), head["height"].alias("height"), F.round(head["frame_rate"], 3).alias("frame_rate"), head["frame_count"].alias("frame_count"), scalar.fourcc(head["fourcc"]).alias("fourcc")), {"ignoreNullFields": "false"})
    return F.when(head["parser_warning"].isNotNull(), F.to_json(F.struct(head["parser_warning"].alias("parser_warning")))).when(still, image).otherwise(film)
