"""Model checkpoints as tables: a row a tensor, read header first, each tensor by its range.

A container is eight bytes of its header's length (least first), the header as JSON (a tensor's dtype, shape and range by
its name, and texts under `__metadata__`), then the tensors' bytes. Spark's own functions read it; a file may have up to
2 GB, larger checkpoints come in several files.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring

#: Bytes of an element, and what reads it.
DTYPES = {"F64": (8, "<f8"), "F32": (4, "<f4"), "F16": (2, "<f2"), "I64": (8, "<i8"), "I32": (4, "<i4"), "U8": (1, "u1"), "BOOL": (1, "?")}
#: Prefixes that wrappers of a model put before its keys, taken off in this order.
PREFIXES = ("module.", "_orig_mod.")
#: Bytes of a checkpoint that may be sent to every worker, and of a header.
MOST_BYTES, MOST_HEADER = 1 << 30, 100 << 20
_ENTRY = "struct<dtype:string,shape:array<long>,data_offsets:array<long>>"


def clean(name: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    """A key without the prefixes, each taken off once."""
    for p in prefixes:
        name = F.when(F.startswith(name, F.lit(p)), F.substr(name, F.lit(len(p) + 1))).otherwise(name)
    return name


def _least_first(raw: Column) -> Column:
    """The number that eight bytes hold, least first; null beyond what a file can have."""
    digits = F.regexp_replace(F.hex(raw), "^(..)(..)(..)(..)(..)(..)(..)(..)$", "$8$7$6$5$4$3$2$1")
    return F.when(F.startswith(digits, F.lit("00000000")), F.conv(F.right(digits, F.lit(8)), 16, 10).cast("long"))


def containers(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, content, size (of the header), header (JSON by key), metadata, problem (null if it can be read)."""
    content = F.col("content")
    size = _least_first(F.substring(content, 1, 8))
    found = files.select("path", "content", size.alias("size"))
    held = F.coalesce((F.col("size") <= F.octet_length("content") - 8) & (F.col("size") <= MOST_HEADER), F.lit(False))
    text = F.when(held, F.try_validate_utf8(F.substr(content, F.lit(9), F.col("size").cast("int")).cast("string")))
    told = found.withColumn("header", F.from_json(text, "map<string,string>"))
    metadata = F.from_json(F.element_at("header", "__metadata__"), "map<string,string>")
    problem = F.when(~held, "not a tensor container").when(F.col("header").isNull(), "header is not JSON")
    return told.select("path", "content", "size", "header", metadata.alias("metadata"), problem.alias("problem"))


def tensors(files: DataFrame, prefixes: Sequence[str] = PREFIXES) -> DataFrame:
    """files (path, content) -> path, key (as written), name (clean), dtype, shape, data, problem.

    A container that can't be read is one row with its problem and no key; so is each entry whose dtype is unknown or whose range
    is not that of its shape or not in the file, with its key. Files without tensors have no rows.
    """
    read = containers(files)
    entry = F.from_json("value", _ENTRY)
    listed = read.filter("problem IS NULL").select("path", "content", "size", F.explode(F.map_filter("header", lambda k, _: k != "__metadata__")).alias("key", "value")).withColumn("e", entry)
    a, b = F.get("e.data_offsets", F.lit(0)), F.get("e.data_offsets", F.lit(1))
    width = F.element_at(F.create_map(*[F.lit(x) for d, (n, _) in DTYPES.items() for x in (d, n)]), F.col("e.dtype"))
    wanted = F.aggregate("e.shape", width.cast("long"), lambda n, d: n * d)
    sound = (a >= 0) & (b >= a) & (b - a == wanted) & (F.lit(8) + F.col("size") + b <= F.octet_length("content"))
    problem = F.when(width.isNull(), "unknown dtype").when(~F.coalesce(sound, F.lit(False)), "range and shape differ")
    data = F.when(problem.isNull(), F.substr("content", (F.col("size") + 9 + a).cast("int"), (b - a).cast("int")))
    good = listed.select("path", "key", clean(F.col("key"), prefixes).alias("name"), F.col("e.dtype").alias("dtype"), F.col("e.shape").alias("shape"), data.alias("data"), problem.alias("problem"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("key", "string"), ("name", "string"), ("dtype", "string"), ("shape", "array<long>"), ("data", "binary"))]
    return good.unionByName(read.filter("problem IS NOT NULL").select("path", *none, "problem"))


def read(spark: SparkSession, path: str, glob: str = "*.safetensors") -> DataFrame:
    """Tensors of the files under a path."""
    return tensors(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content"))


def compared(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Tensors against the model's own (name, shape): name, status: ok, missing, unexpected, differs (another shape), repeated or broken."""
    named = found.groupBy("name").agg(F.count("*").alias("n"), F.any_value("shape").alias("shape"), F.max("problem").alias("problem"))
    both = named.join(expected.select("name", F.col("shape").cast("array<long>").alias("wanted"), F.lit(True).alias("known")), "name", "full")
    status = F.when(F.col("problem").isNotNull(), "broken").when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(F.col("shape") != F.col("wanted"), "differs")
    return both.select("name", F.coalesce(status, F.lit("ok")).alias("status"))


def check(found: DataFrame, expected: DataFrame, critical: Sequence[str]) -> None:
    """An error that names up to five keys if the checkpoint has none, a broken, repeated or differing tensor, or lacks one
    whose name begins with a critical prefix."""
    begins = F.exists(F.array(*map(F.lit, critical)).cast("array<string>"), lambda p: F.startswith(F.col("name"), p))
    wrong = compared(found, expected).filter(F.col("status").isin("broken", "repeated", "differs") | ((F.col("status") == "missing") & begins))
    rows = wrong.orderBy("status", "name").limit(5).collect()
    if rows:
        raise ValueError("unfit checkpoint: " + ", ".join(f"{r['name']} {r['status']}" for r in rows))
    if found.isEmpty():
        raise ValueError("unfit checkpoint: no tensors")


def arrays(found: DataFrame, most_bytes: int = MOST_BYTES) -> dict[str, np.ndarray]:
    """Arrays by name, on the driver; more than most_bytes of them are an error, told before any is fetched."""
    size = found.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"{size} bytes of tensors, {most_bytes} may be sent to workers")
    rows = found.filter("problem IS NULL").select("name", "dtype", "shape", "data").collect()
    return {r["name"]: np.frombuffer(bytes(r["data"]), DTYPES[r["dtype"]][1], count=math.prod(r["shape"])).reshape(r["shape"]) for r in rows}


_BUILT: dict[int, Callable] = {}


def model(spark: SparkSession, found: DataFrame, build: Callable[[dict[str, np.ndarray]], Callable], most_bytes: int = MOST_BYTES) -> Callable[[], Callable]:
    """What scoring.predict takes: build(arrays) gives what maps a batch to logits. The arrays are broadcast, and built
    once a worker, whatever the number of its tasks."""
    shared = spark.sparkContext.broadcast(arrays(found, most_bytes))

    def load() -> Callable:
        if id(shared) not in _BUILT:
            _BUILT.clear()
            _BUILT[id(shared)] = build(shared.value)
        return _BUILT[id(shared)]

    return load


def score(frames: DataFrame, found: DataFrame, build: Callable, *, features: str, batch: int = 4) -> DataFrame:
    """frames with the probability that the checkpoint's model gives to each array of features."""
    return scoring.predict(frames, model(frames.sparkSession, found, build), features=features, batch=batch)
