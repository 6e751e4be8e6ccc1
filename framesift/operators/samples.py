"""Sample tables of MP4 and QuickTime files: a row a sample with its time, place, size, and whether it is a key frame.

A file tells its samples in run lengths: so many samples of one duration, so many a chunk from one chunk on. A
small reader finds the tables of the first video track; expanding them and putting durations, chunks, places
and sizes together is Spark's: explode, running sums over a file's runs, and joins by sample and chunk.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoint import cut

TABLES = "struct<timescale:long,durations:array<struct<n:long,delta:long>>,chunk_runs:array<struct<first:long,per:long>>,sizes:array<long>,samples:long,fixed_size:long,chunks:array<long>,keys:array<long>,warning:string>"
_FIELDS = ("timescale", "durations", "chunk_runs", "sizes", "samples", "fixed_size", "chunks", "keys", "warning")
#: Boxes that hold boxes.
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def boxes(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, start, end of the content) of all boxes, parents before what they hold; cut boxes end with the data."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or end - start
        if size < head:
            raise ValueError("a box is smaller than its head")
        yield (*path, kind), start + head, min(end, start + size)
        if kind in _PARENTS:
            yield from boxes(data, start + head, min(end, start + size), (*path, kind))
        start += size


def _entries(data: bytes, at: int, end: int, form: str) -> list[tuple]:
    """A table's rows: a count, then rows of that form."""
    n, size = struct.unpack_from(">I", data, at + 4)[0], struct.calcsize(form)
    if at + 8 + n * size > end:
        raise ValueError("a table is cut")
    return list(struct.iter_unpack(form, data[at + 8 : at + 8 + n * size]))


def read_tables(data: bytes) -> dict:
    """Tables of the first video track."""
    found: dict[bytes, tuple[int, int]] = {}
    for path, start, end in boxes(data):
        if path[-1] == b"trak":
            if found.get(b"video"):
                break
            found = {}
        elif path[-1] == b"hdlr" and data[start + 8 : start + 12] == b"vide":
            found[b"video"] = (start, end)
        elif path[-2:-1] in ((b"stbl",), (b"mdia",)):
            found[path[-1]] = (start, end)
    if b"video" not in found:
        raise ValueError("no video track")
    at = found[b"mdhd"][0]
    size_at, size_end = found[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, size_at + 4)
    offsets = (b"co64", ">Q") if b"co64" in found else (b"stco", ">I")
    return {
        "timescale": struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0],
        "durations": [{"n": a, "delta": b} for a, b in _entries(data, *found[b"stts"], ">II")],
        "chunk_runs": [{"first": a, "per": b} for a, b, _ in _entries(data, *found[b"stsc"], ">III")],
        "sizes": None if fixed else [s for (s,) in _entries(data, size_at + 4, size_end, ">I")],
        "samples": n, "fixed_size": fixed or None,
        "chunks": [c for (c,) in _entries(data, *found[offsets[0]], offsets[1])],
        "keys": [k for (k,) in _entries(data, *found[b"stss"], ">I")] if b"stss" in found else None,
    }


def tables(content: Column) -> Column:
    """Struct TABLES of whole files; what can't be read is a warning."""

    @F.pandas_udf(TABLES)
    def run(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            found: dict = {}
            if data is not None:
                try:
                    found = read_tables(bytes(data))
                except (ValueError, KeyError, struct.error) as failure:
                    found = {"warning": f"sample tables could not be read: {failure}"}
            rows.append([found.get(n) for n in _FIELDS])
        return pd.DataFrame(rows, columns=_FIELDS, dtype=object)

    return run(content)


def samples(files: DataFrame, *, key: str = "path") -> DataFrame:
    """files (key, tables) -> key, sample (from 0), seconds, duration, offset, size, chunk (from 1), key_frame.

    Without a table of key frames every sample is one. Files without tables, or whose tables have no sample, have no
    rows; samples beyond a table that is too short have nulls there. Keys are unique.
    """
    # The run lengths are cut, so that no file is read again for each of its tables.
    t = cut(files.select(F.col(key).alias("file"), "tables")).filter("tables.warning IS NULL AND tables.timescale > 0").select("file", "tables.*")
    of_file = Window.partitionBy("file")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    listed = t.select("file", F.when(F.col("fixed_size").isNull(), F.col("sizes")).otherwise(F.transform(numbers(F.col("samples")), lambda _: F.col("fixed_size"))).alias("sizes"), "keys")
    base = listed.select("file", F.posexplode("sizes").alias("sample", "size")).withColumn("sample", F.col("sample").cast("long"))

    # Runs of durations: what lies before a run, in samples and time, then its samples one by one.
    before = of_file.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = t.select("file", "timescale", F.posexplode("durations").alias("run", "d"))
    runs = runs.select("file", "timescale", "d.*", F.coalesce(F.sum("d.n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum(F.col("d.n") * F.col("d.delta")).over(before), F.lit(0)).alias("t0"))
    each = runs.select("file", "timescale", "delta", "n0", "t0", F.explode(numbers(F.col("n"))).alias("i"))
    times = each.select("file", (F.col("n0") + F.col("i")).alias("sample"), ((F.col("t0") + F.col("i") * F.col("delta")) / F.col("timescale")).alias("seconds"), (F.col("delta") / F.col("timescale")).alias("duration"))

    # A run of chunks reaches to the next run's first chunk, the last one to the last chunk.
    spans = t.select("file", F.size("chunks").cast("long").alias("last"), F.posexplode("chunk_runs").alias("run", "r"))
    following = F.coalesce(F.lead("r.first").over(of_file.orderBy("run")), F.col("last") + 1)
    spans = spans.select("file", "r.*", (following - F.col("r.first")).alias("n"))
    chunks = spans.select("file", "per", "first", F.explode(numbers(F.col("n"))).alias("i")).select("file", "per", (F.col("first") + F.col("i")).alias("chunk"))
    earlier = of_file.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = t.select("file", F.posexplode("chunks").alias("at", "start")).select("file", (F.col("at") + 1).cast("long").alias("chunk"), "start")
    placed = chunks.withColumn("n0", F.coalesce(F.sum("per").over(earlier), F.lit(0))).join(starts, ["file", "chunk"])
    inside = placed.select("file", "chunk", "start", "n0", F.explode(numbers(F.col("per"))).alias("i")).select("file", "chunk", "start", (F.col("n0") + F.col("i")).alias("sample"))

    key_frames = listed.select("file", F.explode("keys").alias("k")).select("file", (F.col("k") - 1).alias("sample"), F.lit(True).alias("listed")).distinct()
    all_keys = listed.select("file", F.col("keys").isNull().alias("all_keys"))
    joined = base.join(times, ["file", "sample"], "left").join(inside, ["file", "sample"], "left").join(key_frames, ["file", "sample"], "left").join(all_keys, "file")
    in_chunk = Window.partitionBy("file", "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        F.col("file").alias(key), "sample", "seconds", "duration", (F.col("start") + F.coalesce(F.sum("size").over(in_chunk), F.lit(0))).alias("offset"), "size", "chunk",
        (F.col("all_keys") | F.col("listed").isNotNull()).alias("key_frame"),
    )


def sampled(found: DataFrame, *, key: str = "path", interval_seconds: float = 1.0) -> DataFrame:
    """samples -> of each interval that has any the first, by its true time, so variable rates come out right; with the
    key frame that a decoder has to start from."""
    slot = F.floor(F.col("seconds") / interval_seconds)
    start = F.max(F.when(F.col("key_frame"), F.col("sample"))).over(Window.partitionBy(key).orderBy("sample"))
    first = F.row_number().over(Window.partitionBy(key, slot).orderBy("sample"))
    return found.filter("seconds IS NOT NULL").withColumn("decode_from", start).withColumn("_no", first).filter("_no = 1").drop("_no")
