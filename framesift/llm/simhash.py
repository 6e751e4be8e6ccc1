"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most 3 bits
share at least 5 positional bytes, so a pair must be tallied at 5 or more to be verified. Postings
of single bytes would hold 1/256 of all fingerprints each; the index therefore keeps the postings of
four bytes at once. The 14 blocks of the Steiner system S(3, 4, 8) are enough: whichever three bytes
differ lie in one block, and its complement, again a block, is shared whole. Of the pairs of a posting
list, which share four bytes, the tally over all eight keeps those that share a fifth; these are verified
by their differing bits. A long list is tallied by the index too: it is dealt again by each of its other
bytes, so that only fingerprints with a fifth byte in common meet.

Equal fingerprints are one entry. Within a posting list only a spanning forest of the verified
links leaves the task, which joins the same fingerprints as all its pairs would; lists that are long
even so are dealt to cells of bounded size, one for each pair of parts, so no task is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, table
from ..functions.graph import connected_components

SHINGLE_WORDS = 3
HASH_SEED = 42
MOST_BITS = 3
#: Of the 8 bytes, those that 3 or fewer differing bits leave alike.
LEAST_SHARED = 8 - MOST_BITS
#: Blocks of S(3, 4, 8), the affine planes of three-bit vectors: four byte positions whose xor is 0.
BLOCKS = tuple((a, b, c, a ^ b ^ c) for a in range(8) for b in range(a + 1, 8) for c in range(b + 1, 8) if c < a ^ b ^ c)
#: Fingerprints in one part of a long posting list.
PART = 512


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles; a bit is set if it is set in over half of them. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE_WORDS))))
    n = len(words) - SHINGLE_WORDS + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), np.uint64, n)
    ones = np.empty(64, np.int64)
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):  # eight counters of a byte each, summed before they overflow
        partial = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, np.arange(0, n, 255))
        ones[bit::8] = partial.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; null and blank texts have 0."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                fp = np.fromiter((fingerprint(x) for x in batch.column(1).to_pylist()), np.uint64, len(batch)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(make, f"doc_id {kind}, fp long")


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all verified pairs of these fingerprints join."""
    bytes_ = fps.view(np.uint8).reshape(len(fps), 8)
    tally = np.zeros((len(fps), len(fps)), np.uint8)
    for k in range(8):
        tally += bytes_[:, None, k] == bytes_[None, :, k]
    i, j = np.nonzero(np.triu(tally >= LEAST_SHARED, 1))
    near = np.bitwise_count(fps[i] ^ fps[j]) <= MOST_BITS
    i, j = i[near], j[near]
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, key, i, j, fp) sorted by cell -> forest links (a, b) of each cell."""
    held: tuple | None = None
    parts: list[np.ndarray] = []

    def links(fps: np.ndarray) -> pa.RecordBatch:
        a, b = _forest(np.unique(fps))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        cell = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], axis=1)
        fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)]) if len(cell) else []
        for s, e in zip(starts, [*starts[1:], len(cell)]):
            if held is not None and tuple(cell[s]) != held:
                yield links(np.concatenate(parts))
                parts = []
            held = tuple(cell[s])
            parts.append(fps[s:e])
    if parts:
        yield links(np.concatenate(parts))


def _key(positions: Sequence[int]) -> Column:
    """Those bytes of fp as one number."""
    value = F.lit(0).cast("long")
    for k in positions:
        value = value * 256 + F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255).cast("long"))
    return value


def near_links(fps: DataFrame, part: int = PART) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that join all fingerprints at 3 or fewer bits.

    A list is a block, or for long ones a block and a fifth byte: 8 * block + position, beyond all blocks.
    """
    keys = [F.struct(F.lit(no).alias("list"), _key(block).alias("key")) for no, block in enumerate(BLOCKS)]
    postings = fps.select("fp", F.inline(F.array(*keys)))
    lengths = postings.groupBy("list", "key").agg(F.count("*").alias("n")).filter("n > 1")
    listed = cut(postings.join(lengths, ["list", "key"]))
    fifth = [F.struct(F.lit(8 * (no + 2) + k).alias("list"), _key((*block, k)).alias("key")) for no, block in enumerate(BLOCKS) for k in range(8) if k not in block]
    of_block = F.filter(F.array(*fifth), lambda x: F.call_function("div", x["list"], F.lit(8)) == F.col("list") + 2)
    long = listed.filter(F.col("n") > part).select("fp", F.inline(of_block))
    again = long.join(long.groupBy("list", "key").agg(F.count("*").alias("n")).filter("n > 1"), ["list", "key"])
    cells = (
        listed.filter(F.col("n") <= part).unionByName(again)
        .withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("list", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    dealt = cells.repartition("list", "key", "i", "j").sortWithinPartitions("list", "key", "i", "j")
    return dealt.mapInArrow(_link_cells, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (signed), component_id, the least doc_id reachable.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; repeated rows and
    ties share a fingerprint; a null doc_id takes part but is never a component's id unless it is
    alone; an empty table gives an empty result. A bit that half of the hashes set is 0. Very long texts are
    read whole, a text's hashes at a time. Other columns are ignored, whatever their names.
    """
    marked = cut(fingerprints(docs, id_col=id_col, text_col=text_col))
    firsts = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    members = connected_components(near_links(firsts.select("fp")))
    grouped = firsts.join(members.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    named = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = grouped.join(named, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
