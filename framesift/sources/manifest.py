"""Records of CSV files whose cells may hold line breaks, numbered, whatever the splits they are read in.

Files are read as lines, in blocks as Spark splits them. Whether a line begins inside quotes follows from the quotes
before it: those of earlier blocks, a row a block, and those before it in its block, counted as the block is read. So records
and their numbers are told without a task that reads a whole file, and without moving a line; only the lines of records that
hold line breaks are brought together.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoint import stored

#: Different headers that one read may have.
MOST_HEADERS = 1000
BOM = "\ufeff"


_PLACED = "file string, block long, at long, value string, quotes long, blank boolean, odd boolean, even_record long, odd_record long"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of blocks, as they come, with what stands before them in their block: whether an odd number of quotes, and the
    number of records begun, theirs included, if the block begins outside quotes (even) or inside (odd)."""
    now, quotes, even, odd = None, 0, 0, 0
    for b in batches:
        files, blocks = b.column(0).to_pylist(), b.column(1).to_numpy()
        n, blank = b.column(4).to_numpy(), b.column(5).to_numpy(zero_copy_only=False).astype(bool)
        cuts = [0, *[i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]], len(files)]
        inside, evens, odds = np.zeros(len(files), bool), np.zeros(len(files), np.int64), np.zeros(len(files), np.int64)
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if (files[start], blocks[start]) != now:
                now, quotes, even, odd = (files[start], blocks[start]), 0, 0, 0
            part = slice(start, end)
            inside[part] = (quotes + np.cumsum(n[part]) - n[part]) % 2 == 1
            evens[part] = even + np.cumsum(~inside[part] & ~blank[part])
            odds[part] = odd + np.cumsum(inside[part] & ~blank[part])
            quotes, even, odd = quotes + int(n[part].sum()), int(evens[end - 1]), int(odds[end - 1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(inside), pa.array(evens), pa.array(odds)], [x.split()[0] for x in _PLACED.split(", ")])


def raw_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, record (1 is the header), text of each record of CSV files.

    Quotes are doubled inside quotes. A byte order mark and carriage returns before line breaks are left out, as are empty lines
    between records. A quote that is never closed makes the rest of its file one record.
    """
    value = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value",
        (F.length(value) - F.length(F.replace(value, F.lit('"')))).cast("long").alias("quotes"), value.isin("", "\r", BOM).alias("blank"),
    )
    placed = lines.mapInArrow(_placed, _PLACED)
    # A row a block: whether it begins inside quotes, then how many records were begun before it.
    of_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(of_file), F.lit(0))
    narrow = lines.withColumn("value", F.lit("")).mapInArrow(_placed, _PLACED)
    blocks = narrow.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.max("even_record").alias("even"), F.max("odd_record").alias("odd"))
    blocks = blocks.withColumn("inside", earlier("quotes") % 2 == 1)
    # Stored, its size is known: few blocks are broadcast, and no line is moved to meet them.
    blocks = stored(blocks.select("file", "block", F.col("inside").alias("begins_inside"), earlier(F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))).alias("before")))
    told = placed.join(blocks, ["file", "block"]).withColumn("inside", F.col("odd") != F.col("begins_inside")).filter(F.col("inside") | ~F.col("blank"))
    record = F.col("before") + F.when(F.col("begins_inside"), F.col("odd_record")).otherwise(F.col("even_record"))
    numbered = told.select("file", "block", "at", "value", record.alias("record"), (~F.col("inside") & (F.col("quotes") % 2 == 0)).alias("alone"))
    parts = numbered.filter("NOT alone").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))  # one record's lines
    records = numbered.filter("alone").select("file", "record", "value").unionByName(parts.select("file", "record", F.array_join("parts.value", "\n").alias("value")))
    bare = F.regexp_replace(F.when(F.col("record") == 1, F.regexp_replace("value", f"^{BOM}", "")).otherwise(F.col("value")), r"\r\z", "")
    return records.select("file", "record", bare.alias("text"))


def csv_records(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """file, line (the record's number, the header being 1) and the named columns as text.

    Files may order their columns each in its own way and have others; one that lacks a named column is an error that
    says which. Cells that a short record lacks are empty, as empty ones are. Of columns of one name the first counts.
    """
    records = raw_records(spark, path)
    heads = stored(records.filter("record = 1").select("file", F.col("text").alias("head")))
    found = [r["head"] for r in heads.select("head").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(found) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    columns = {h: next(csv.reader([h]), []) for h in found}
    for has in columns.values():
        if missing := sorted(set(names) - set(has)):
            raise ValueError(f"missing columns: {', '.join(missing)}")
    wide = max(map(len, columns.values()), default=1)
    places = spark.createDataFrame([(h, [has.index(n) for n in names]) for h, has in columns.items()], "head string, places array<int>")
    cells = F.from_csv("text", F.lit(", ".join(f"c{i} string" for i in range(wide))), {"quote": '"', "escape": '"', "emptyValue": "", "maxCharsPerColumn": "-1", "lineSep": "\0"})
    read = records.filter("record > 1").join(heads, "file").join(F.broadcast(places), "head").withColumn("cells", cells)  # at most MOST_HEADERS rows
    listed = F.array(*[F.col(f"cells.c{i}") for i in range(wide)])
    return read.select("file", F.col("record").alias("line"), "places", listed.alias("cells")).select("file", "line", *[F.coalesce(F.get("cells", F.get("places", F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)])
