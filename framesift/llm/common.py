"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoint import cut, ensure_checkpoint_dir, release, remove, shared_folder, stored, stored_so_far

__all__ = ["SPACES", "SPACE_RUN", "by_bytes", "crc_fold", "cut", "ensure_checkpoint_dir", "release", "remove", "shared_folder", "small", "stored", "stored_so_far", "table", "thinned", "word_count"]

#: Word separators: space and the ASCII controls tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


#: Rows up to which a table made on the driver is broadcast; beyond, joins shuffle and AQE splits skew.
MOST_BROADCAST = 10_000


def small(table_: DataFrame, rows: int) -> DataFrame:
    """A driver-made table of so many narrow rows, hinted for broadcast if that is few enough: Spark takes
    its size for unknown, and would else shuffle the other side by what may be one hot key."""
    return F.broadcast(table_) if rows <= MOST_BROADCAST else table_


def thinned(rows: DataFrame, pick: Column, wanted: int) -> DataFrame:
    """Rows of lowest hash, about twice as many as wanted: what is then ordered for a sample of a bounded
    size stays bounded itself, however many rows there are. pick: a 64-bit hash; counts the rows first."""
    n = rows.count()
    return rows if n <= 2 * wanted else rows.filter(pick <= -(1 << 63) + (1 << 64) * 2 * wanted // n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most `most` bytes in one string column, at least a row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)
