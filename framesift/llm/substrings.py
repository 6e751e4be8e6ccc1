"""Repeated-substring removal by bucket refinement over later offsets.

Two places of the corpus lie in one bucket of depth L if their next L bytes are equal. A bucket's
identifier is a 64-bit hash; that of depth 2 L refines (bucket of depth L here, bucket of depth L at
offset L), so the identifiers of depths 1, 2, 4, ... reach any depth by reuse, and depth 50 is (depth
32 here, depth 32 at offset 18). Refinement goes in three rounds, each over what the last left open:

1. q-gram buckets. Of the GRAM-byte buckets inside each 50-byte string, the least identifier is its
   anchor; equal strings have equal anchors at equal offsets. Consecutive strings of one text with
   one anchor make a segment: one row (anchor's bucket, bucket of the whole segment, document, place).
2. Rows are dealt and sorted by (anchor's bucket, segment's bucket, document). A bucket with one
   segment is settled. Equal segments of a later document are covered whole by the first document's;
   of the first document each one goes on, as a smaller document may hold its strings in another segment.
   What a batch of rows can tell by itself is told before: of equal segments only that of the least
   document is dealt by its anchor, of repeats inside one text only the first, and of an anchor with many
   different segments two that show it to be shared, so that the bucket of a passage which very many
   documents hold gets a bounded number of rows from each batch.
3. A 50-byte string reaches at least half of its other bytes beyond its anchor on one side. Segments
   that differ inside an anchor's bucket are refined by the buckets of those two SIDE-byte strings;
   segments that share neither with another document are settled. The rest go down to their single
   50-byte strings, whose least document decides. What one batch of rows can tell it tells: of rows of
   one bucket only that of the least document is dealt by the bucket, the others keep the document
   that they saw and are dealt anywhere, so a bucket that very many documents share stays small.

Equality rests on pairs of 64-bit identifiers (anchor and string), not on one. Bytes are removed from
whole texts at the end, joined by document. No list of a bucket is ever collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, stored, table

DEPTH = 50
#: q-grams of the first buckets; the anchors of a 50-byte string are chosen among 50 - GRAM + 1.
GRAM = 20
#: Bytes of the strings that hold an anchor and reach beyond it on one side.
SIDE = GRAM + (DEPTH - GRAM + 1) // 2
#: Bytes of text that are read at once.
PIECE = 1 << 15
#: Any place in a piece has so many bits.
PLACE_BITS = 16
#: Different segments of one anchor that one batch of rows deals by that anchor.
MOST_DEALT = 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _refine(here: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket identifiers of (bucket here, bucket at a later offset)."""
    x = here * _A
    x += later
    x ^= x >> np.uint64(29)
    x *= _B
    return x


#: Buckets of depth 1, by byte.
_BYTES = _refine(_refine(np.arange(1, 257, dtype=np.uint64), _B) ^ _A, _A)


def buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers of the GRAM-, SIDE- and DEPTH-byte bucket at each place that has so many bytes left."""
    level, depth = _BYTES[data], 1
    at = lambda d: _refine(level[: len(data) - d + 1], level[d - depth : len(data) - depth + 1])
    found = {}
    while True:
        found |= {d: at(d) for d in (GRAM, SIDE, DEPTH) if depth < d <= 2 * depth}
        if DEPTH in found:
            return found[GRAM], found[SIDE], found[DEPTH]
        level = _refine(level[:-depth], level[depth:])
        depth *= 2


def anchors(gram: np.ndarray, strings: int) -> np.ndarray:
    """Place of each string's anchor: its least q-gram identifier but for the last PLACE_BITS bits, the first
    such place on a tie. That is the same for equal strings wherever they stand."""
    width = DEPTH - GRAM + 1
    mask = np.uint64((1 << PLACE_BITS) - 1)
    # The place rides in the low bits, so minima of overlapping stretches keep it.
    least, span = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64), 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return (np.minimum(least[:strings], least[width - span : width - span + strings]) & mask).astype(np.int64)


@dataclass
class Piece:
    """Texts laid end to end: which row each place belongs to, where that row's text starts and ends, and
    the place of the first byte in its text."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offset: np.ndarray


def pieces(texts: list[bytes]) -> Iterator[Piece]:
    """Whole texts put together, and long texts cut, to about PIECE bytes each. Pieces of one text overlap,
    so that each of its strings lies whole in just one of them."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def piece() -> Piece:
        lengths = np.array([len(x) for _, _, x in held])
        ends = np.cumsum(lengths)
        return Piece(np.frombuffer(b"".join(x for _, _, x in held), np.uint8), np.array([r for r, _, _ in held]), ends - lengths, ends, np.array([o for _, o, _ in held]))

    for row, text in enumerate(texts):
        for offset in range(0, len(text) - DEPTH + 1, PIECE):
            part = text if len(text) <= PIECE else text[offset : offset + PIECE + DEPTH - 1]
            if held and size + len(part) > PIECE:
                yield piece()
                held, size = [], 0
            held.append((row, offset, part))
            size += len(part)
            if len(part) == len(text):
                break
    if held:
        yield piece()


@dataclass
class Segments:
    """Columns of a piece's segments: anchor's bucket, segment's bucket, row, first string's place in the
    text, strings, and the anchor's place in the piece; with the buckets of all strings and sides."""

    anchor: np.ndarray
    whole: np.ndarray
    row: np.ndarray
    first: np.ndarray
    strings: np.ndarray
    at: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    deep: np.ndarray
    side: np.ndarray


def segments(piece: Piece) -> Segments:
    gram, side, deep = buckets(piece.data)
    inside = np.ones(len(deep), bool)
    for end in piece.end[:-1].tolist():  # no string crosses the end of a text
        inside[end - DEPTH + 1 : end] = False
    strings = np.flatnonzero(inside)
    at = anchors(gram, len(deep))[strings]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    first, last = strings[new], strings[np.r_[new[1:], len(strings)] - 1]
    at = at[new]
    # The strings at both ends hold every byte of a segment between them, as they overlap.
    shape = ((last - first) * 64 + (at - first)).astype(np.uint64)
    whole = _refine(_refine(deep[first], deep[last]), shape)
    of = np.searchsorted(piece.start, first, side="right") - 1
    place = first - piece.start[of] + piece.offset[of]
    return Segments(gram[at], whole, piece.row[of], place, last - first + 1, at, first, piece.start[of], piece.end[of], deep, side)


#: A row of the input: its id, and where other texts have that id, a hash of its text.
_ROW = ["doc_no", "text_no"]


def _gathered(parts: Iterator[list[np.ndarray]], finish, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Arrow batches that `finish` makes of about `most` rows at a time of the columns given in parts."""
    held: list[list[np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield finish(*(np.concatenate(c) for c in zip(*held)))
            held, size = [], 0
    if size:
        yield finish(*(np.concatenate(c) for c in zip(*held)))


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], list(columns))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], pa.RecordBatch]]:
    """Ids, text hashes and texts of batches (doc_no, text_no, text, ...) of a bounded number of bytes."""
    for whole in batches:
        for batch in by_bytes(whole, 2):
            doc, text_no = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield doc, text_no, batch.column(2).cast(pa.large_binary()).to_pylist(), batch


#: What the batch of a segment's row could tell: nothing; that a smaller document holds the segment; that
#: `segment` is another place of this text that holds it; that it has to be refined.
DEALT, COVERED, COPY, OPEN = range(4)


def _told_segments(anchor, whole, doc, text_no, first, strings) -> pa.RecordBatch:  # noqa: ANN001
    """Rows of one batch of segments. Of equal segments only that of the least document is dealt by its
    anchor, and of an anchor's segments beyond MOST_DEALT only those of the least and of the greatest
    document, which show the others of the corpus that it is shared; these others are open already."""
    bits = np.uint64((1 << len(doc).bit_length()) - 1)
    order = np.sort((anchor & ~bits) | np.arange(len(doc), dtype=np.uint64))
    alike = order[1:] & ~bits == order[:-1] & ~bits
    # Most anchors stand in the batch just once; what follows looks at the others.
    by = (order[np.r_[False, alike] | np.r_[alike, False]] & bits).astype(np.int64)
    by = by[np.lexsort((first[by], text_no[by], doc[by], whole[by], anchor[by]))]
    kind, segment, free = np.full(len(doc), DEALT), whole, np.zeros(len(doc), bool)
    if len(by):
        a, w, d, t, f = anchor[by], whole[by], doc[by], text_no[by], first[by]
        new = np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        told = np.where(d > d[head], COVERED, DEALT)
        told[np.r_[False, ~new[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1])] & (told == DEALT)] = COPY
        # The place that a copy names is the last one of its text that is no copy itself.
        named = np.maximum.accumulate(np.where(told == COPY, 0, np.arange(len(d))))
        dealt = np.flatnonzero(told == DEALT)
        group = np.flatnonzero(np.r_[True, a[dealt][1:] != a[dealt][:-1]])
        size = np.diff(np.r_[group, len(dealt)])
        for i, n in zip(group[size > MOST_DEALT].tolist(), size[size > MOST_DEALT].tolist()):
            rows = dealt[i : i + n]
            ends = rows[[d[rows].argmin(), d[rows].argmax()]]
            if d[ends[0]] < d[ends[1]]:
                told[rows] = OPEN
                told[ends] = DEALT
        kind[by], free[by] = told, told != DEALT
        segment = whole.copy()
        segment[by] = np.where(told == COPY, f[named].view(np.uint64), w)
    # Rows that are told already are dealt anywhere.
    anchor = np.where(free, _refine(_refine(doc.view(np.uint64), text_no.view(np.uint64)), first.view(np.uint64)), anchor)
    return _batch({"doc_no": doc, "text_no": text_no, "anchor": anchor, "segment": segment, "place": (first << 7) + ((strings - 1) << 2) + kind})


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[list[np.ndarray]]:
        for doc, text_no, texts, _ in _texts(batches):
            for piece in pieces(texts):
                s = segments(piece)
                yield [s.anchor, s.whole, doc[s.row], text_no[s.row], s.first, s.strings]

    yield from _gathered(parts(), _told_segments)


def _open_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Segments, np.ndarray, np.ndarray]]:
    """Ids and text hashes of a batch, a piece's segments, which of them are open, and on which sides, from
    (doc_no, text_no, text, open). open: a place's number times 4 plus its sides, and the place itself; for a
    copy the place that it names, whose sides it has if that one is open."""
    for doc, text_no, texts, batch in _texts(batches):
        lists = batch.column(3)
        row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        marks, of = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        key, named, side = (row << 34) + (marks >> 2), (row << 34) + of, marks & 3
        own = np.flatnonzero(key == named)
        own = own[np.argsort(key[own])]
        at = np.minimum(np.searchsorted(key[own], named), max(0, len(own) - 1))
        keep = np.flatnonzero(key[own][at] == named) if len(own) else own
        key, side = key[keep], side[own[at[keep]]]
        by = np.argsort(key)
        key, side = key[by], side[by]
        for piece in pieces(texts):
            s = segments(piece)
            place = (s.row << 34) + s.first
            at = np.minimum(np.searchsorted(key, place), max(0, len(key) - 1))
            chosen = np.flatnonzero(key[at] == place) if len(key) else np.zeros(0, np.int64)
            if len(chosen):
                yield doc, text_no, s, chosen, side[at[chosen]]


LEFT, RIGHT = 1, 2
#: Stands for the place that a copy names in spans that the last round told.
LATE = -1


def _side_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each side of each open segment that lies inside the text."""

    def parts() -> Iterator[list[np.ndarray]]:
        for doc, text_no, s, chosen, _ in _open_segments(batches):
            left = chosen[s.at[chosen] - (SIDE - GRAM) >= s.low[chosen]]
            right = chosen[s.at[chosen] + SIDE <= s.high[chosen]]
            both = np.r_[left, right]
            bucket = np.r_[_refine(s.side[s.at[left] - (SIDE - GRAM)], np.uint64(1)), s.side[s.at[right]]]
            mark = (s.first[both] << 2) + np.repeat([LEFT, RIGHT], [len(left), len(right)])
            yield [doc[s.row[both]], text_no[s.row[both]], s.anchor[both], bucket, mark]

    yield from _gathered(parts(), _told_sides)


def _owners(doc: np.ndarray, anchor: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their buckets; the least document of each row's bucket, and the greatest."""
    by = np.lexsort((doc, bucket, anchor))
    new = np.r_[True, (anchor[by][1:] != anchor[by][:-1]) | (bucket[by][1:] != bucket[by][:-1])]
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return by, doc[by][heads][group], doc[by][np.r_[heads[1:], len(by)] - 1][group]


def _told_sides(doc, text_no, anchor, bucket, mark) -> pa.RecordBatch:  # noqa: ANN001
    """Marks the rows of buckets that hold several documents in this batch. One row of each bucket's least
    document is dealt by the bucket, and all of them where the batch knows no other; the rest anywhere."""
    by, owner, most = _owners(doc, anchor, bucket)
    doc, text_no, bucket, anchor, mark = doc[by], text_no[by], bucket[by], anchor[by], mark[by]
    shared = owner < most
    head = np.r_[True, (anchor[1:] != anchor[:-1]) | (bucket[1:] != bucket[:-1])]
    free = _refine(_refine(bucket, doc.view(np.uint64)), _refine(text_no.view(np.uint64), mark.view(np.uint64)))
    return _batch({"doc_no": doc, "text_no": text_no, "anchor": anchor, "bucket": np.where(shared & ~head, free, bucket), "mark": (mark >> 2 << 3) + (shared << 2) + (mark & 3)})


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of open segments that hold a shared side."""

    def parts() -> Iterator[list[np.ndarray]]:
        for doc, text_no, s, chosen, side in _open_segments(batches):
            # Strings that start up to here reach over the whole left side, from here on over the right one.
            middle = s.at[chosen] - (SIDE - GRAM)
            start, end = s.start[chosen], s.start[chosen] + s.strings[chosen]
            start = np.where(side & LEFT, start, np.maximum(start, np.minimum(middle, end)))
            end = np.where(side & RIGHT, end, np.minimum(end, np.maximum(middle + 1, start)))
            n = np.maximum(end - start, 0)
            which = np.repeat(chosen, n)
            at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield [doc[s.row[which]], text_no[s.row[which]], s.anchor[which], s.deep[at], at - s.start[which] + s.first[which]]

    yield from _gathered(parts(), _told_strings, 1 << 19)


def _told_strings(doc, text_no, anchor, bucket, first) -> pa.RecordBatch:  # noqa: ANN001
    """A row for each string of the least document of its bucket in this batch, dealt by bucket; strings that
    the batch saw in a smaller document are told, as one row for a run of places. place: the first place,
    by how much further the last lies, and whether the row is told."""
    by, owner, _ = _owners(doc, anchor, bucket)
    told = owner < doc[by]
    dealt, gone = by[~told], by[told]
    gone = gone[np.lexsort((first[gone], text_no[gone], doc[gone]))]
    d, t, f = doc[gone], text_no[gone], first[gone]
    heads = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (f[1:] - f[:-1] > DEPTH)]) if len(gone) else np.zeros(0, np.int64)
    further = f[np.r_[heads[1:], len(gone)] - 1] - f[heads] if len(gone) else heads
    rows = np.r_[dealt, gone[heads]]
    free = _refine(_refine(d[heads].view(np.uint64), t[heads].view(np.uint64)), f[heads].view(np.uint64))
    place = (first[rows] << 30) + np.r_[np.zeros(len(dealt), np.int64), (further << 1) + 1]
    return _batch({"doc_no": doc[rows], "text_no": text_no[rows], "bucket": np.r_[_refine(anchor[dealt], bucket[dealt]), free], "check": np.r_[bucket[dealt], free], "place": place})


def _runs(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the maximal runs of places [start, end) that each row's spans cover."""
    by = np.lexsort((start, row))
    row, start, end = row[by], start[by], end[by]
    reach = np.maximum.accumulate((row << 34) + end)  # a later row's places lie beyond all of an earlier one's
    new = np.r_[True, (row << 34)[1:] + start[1:] > reach[:-1]] if len(row) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(row)] - 1 if len(row) else heads
    return row[heads], start[heads], reach[tails] - (row[heads] << 34)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> doc_id, bytes, bytes removed, runs removed, and SHA-256 of what is left."""
    for whole in batches:
        for batch in by_bytes(whole, 1):
            texts, lists = batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2)
            held = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            row, spans = np.repeat(np.arange(len(batch)), held), lists.flatten()
            start, end = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            of = spans.field(2).fill_null(LATE - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            sure = np.unique(((row << 34) + start)[of == LATE - 1])
            keep = (of < 0) | np.isin((row << 34) + of, sure)
            row, start, end = _runs(row[keep], start[keep], end[keep])
            removed = np.bincount(row, weights=end - start, minlength=len(batch)).astype(np.int64)
            bounds = np.searchsorted(row, np.arange(len(batch) + 1)).tolist()
            start, end, kept = start.tolist(), end.tolist(), []
            for text, a, z in zip(texts, bounds, bounds[1:]):
                rest, at = hashlib.sha256(), 0
                for i in range(a, z):
                    rest.update(text[at : start[i]])
                    at = end[i]
                rest.update(text[at:])
                kept.append(rest.hexdigest())
            columns = [pa.array(list(map(len, texts)), pa.int64()), pa.array(removed), pa.array(np.diff(bounds).astype(np.int64)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Ids are integers. A byte goes if a 50-byte string over it also starts in a row with a smaller id:
    rows that repeat an id never remove from each other, and a null id counts as the smallest long.
    Very long texts are read whole, in pieces that overlap.
    Null texts are empty; texts under 50 bytes stay whole; an empty table gives an empty result.
    """
    least = F.lit(-(2**63))
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), least).alias("doc_no"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Ids that stand by different texts are few, or none: only their rows need the text's hash to be told apart.
    hashed = given.select("doc_no", F.xxhash64("text").alias("h")).groupBy("doc_no").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    repeated = stored(hashed.filter("low <> high").select("doc_no", F.lit(True).alias("repeated")))
    given = given.join(repeated, "doc_no", "left").select("doc_id", "doc_no", "text", F.when(F.col("repeated"), F.xxhash64("text")).otherwise(0).cast("long").alias("text_no"))
    texts = given.select(*_ROW, "text")
    rows = texts.filter(F.octet_length("text") >= DEPTH).mapInArrow(_segment_rows, "doc_no long, text_no long, anchor long, segment long, place long")
    kind, bucket = F.col("place").bitwiseAND(3), Window.partitionBy("anchor")
    shared = rows.repartition("anchor").select(
        "*", (F.min("segment").over(bucket) != F.max("segment").over(bucket)).alias("open"), (F.min("doc_no").over(bucket) != F.max("doc_no").over(bucket)).alias("across")
    ).filter((kind != DEALT) | F.col("across"))
    own = F.min("doc_no").over(Window.partitionBy("anchor", "segment")) == F.col("doc_no")
    told = shared.select(*_ROW, "segment", "open", kind.alias("kind"), F.shiftright("place", 7).cast("int").alias("first"), (F.shiftright("place", 2).bitwiseAND(31) + 1).cast("int").alias("strings"), own.alias("own"))
    told = told.select(
        *_ROW, "first", "strings", F.when(F.col("kind") == COPY, F.col("segment")).otherwise(F.col("first")).cast("int").alias("of"),
        ((F.col("kind") == COVERED) | ((F.col("kind") == DEALT) & ~F.col("own"))).alias("covered"),
        ((F.col("kind") == OPEN) | ((F.col("kind") == DEALT) & F.col("own") & F.col("open"))).alias("refine"),
    )
    told = stored(told.filter("covered OR refine OR of <> first"))
    copies = F.col("of") != F.col("first")

    def refined(places: DataFrame, rows_of, columns: str) -> DataFrame:  # noqa: ANN001
        """rows_of the texts with their open places (mark, of)."""
        by_text = places.groupBy(*_ROW).agg(F.collect_set(F.struct("mark", "of")).alias("open"))  # rows of one id and text have the same places
        return texts.join(by_text, _ROW).select(*_ROW, "text", "open").mapInArrow(rows_of, f"doc_no long, text_no long, {columns}")

    place = lambda rows: rows.select(*_ROW, (F.shiftleft(F.col("first").cast("long"), 2) + LEFT + RIGHT).alias("mark"), F.col("of").cast("long").alias("of"))
    sides = refined(place(told.filter("refine")), _side_rows, "anchor long, bucket long, mark long").repartition("anchor", "bucket")
    one = Window.partitionBy("anchor", "bucket")
    known = sides.select(*_ROW, "mark", ((F.col("mark").bitwiseAND(4) > 0) | (F.min("doc_no").over(one) != F.max("doc_no").over(one))).alias("shared")).filter("shared")
    first = F.shiftright("mark", 3)
    open_ = stored(known.groupBy(*_ROW, first.alias("of")).agg((F.shiftleft(F.min(first), 2) + F.bit_or(F.col("mark").bitwiseAND(3))).alias("mark")))
    strings = refined(open_.unionByName(place(told.filter(copies))), _string_rows, "bucket long, check long, place long").repartition("bucket", "check")
    same = Window.partitionBy("bucket", "check")
    late = strings.select(*_ROW, "place", ((F.col("place").bitwiseAND(1) == 1) | (F.min("doc_no").over(same) < F.col("doc_no"))).alias("gone")).filter("gone")
    start = F.shiftright("place", 30)
    end = start + F.shiftright("place", 1).bitwiseAND(F.lit((1 << 29) - 1).cast("long")) + DEPTH
    late = stored(late.select(*_ROW, start.cast("int").alias("start"), end.cast("int").alias("end")))
    whole = told.filter(F.col("covered") | copies).select(*_ROW, F.col("first").alias("start"), (F.col("first") + F.col("strings") - 1 + DEPTH).alias("end"), F.when(copies, F.col("of")).alias("of"))
    spans = whole.union(late.withColumn("of", F.lit(LATE))).groupBy(*_ROW).agg(F.collect_set(F.struct("start", "end", "of")).alias("spans"))

    id_kind = given.schema["doc_id"].dataType.simpleString()
    return given.join(spans, _ROW, "left").select("doc_id", "text", "spans").mapInArrow(_clean, f"doc_id {id_kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: The same by all 50-byte strings, as hexadecimal text.
ORACLE_SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * DEPTH}) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - {DEPTH - 1}, 0))) AS p FROM h)),
m AS (SELECT s, min(doc_id) AS m FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM s JOIN m USING (s) WHERE m < doc_id),
k AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + {DEPTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
r AS (SELECT doc_id, min(p) AS a, max(p) + {DEPTH} AS z FROM k GROUP BY doc_id, run),
g AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM r),
t AS (SELECT doc_id, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM g JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, h.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM h LEFT JOIN t USING (doc_id)
"""
