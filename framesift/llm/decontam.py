"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts are read as letters: words (lower-cased runs of letters, digits and non-ASCII bytes) apart by one
space each. The CGK walk reads a window from its first letter: at step j it writes the letter under it and
moves on if a random bit of (j, letter) is set, so windows at small edit distance fall into step again and
agree in most written places: edit distance becomes Hamming distance. A repetition draws its own bits and
samples some of the written places; windows that agree in all of them collide. Windows start at every word
of every document, and at every word inside each item-sized passage that is looked for, so an edited
passage is met wherever one stretch of it still agrees in the sampled places. Walks are shorter for shorter
items (WALKS); windows that agree in their first places only count where two of them stand in line.

Items of fewer letters than any walk's have no stretch that edits are likely to spare. They are found exactly: cut in more
parts than they may have edits, some parts are met unchanged and in line in any passage within the limit. Items of under
WHOLE letters, a word or three, are defined to be found unchanged only, as whole words.

All hits of one text and item that stand in line align an item-sized stretch of the document, which is verified by the exact
edit distance of the item to the best matching part of it; verified pairs have a similarity 1 - distance / length of at
least 0.8. No such stretch is left out. Walks, repetitions and places are set for the recall that tests/llm measures on
fresh items of every length. Items come in blocks of bounded size, each broadcast; more items take more passes over the
documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import by_bytes, stored, table

SIMILARITY = 0.8


@dataclass(frozen=True)
class Walk:
    """How windows of items of `least` letters or more, up to the next walk's, are read: steps, places sampled of them (one from
    each of equal stretches, as neighbouring places often read one letter), and how often that is repeated with other
    random bits and places. Windows that agree in the first `part` places collide in part."""

    least: int
    steps: int
    places: int
    part: int
    repetitions: int


#: Windows grow with the items: a short item with a fifth of its letters edited has no long stretch untouched.
WALKS = (Walk(80, 28, 14, 11, 4), Walk(128, 36, 14, 10, 3))
SEED = 23
#: After so many sampled places, windows that no item agrees with so far are left.
CHECK = 6
#: Two collisions in part, of windows that start so many letters apart in the item, count like a whole one.
APART = 12
#: Letters of items that are found by parts that no edit touches, and of those found unchanged only.
EXACT, WHOLE = WALKS[0].least, 20
#: Letters of such a part, or fewer where the item has too few.
PART_LETTERS = 3
#: Letters by which a collision's alignment may be off beside the edits allowed.
SLACK = 8
#: Slots that tell windows which no item can match, as powers of two; their number follows the block's windows.
LEAST_SLOTS, MOST_SLOTS = 20, 22
#: Bytes of item text in one broadcast block, and of documents read at once.
BLOCK_BYTES, SLICE_BYTES = 4 << 20, 1 << 19
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SPACE, _STOP = 32, 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    x ^= x >> np.uint64(31)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


_WORD = np.zeros(256, bool)
_WORD[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True


class Letters:
    """Letters of several texts in a row, words apart by a space, each text ended by a stop.

    start: place of each word. first: first word of each text. source: where the words' letters stand in
    the lower-cased bytes `data`; place: where they stand here. offsets: where each text starts in data.
    """

    def __init__(self, texts: pa.Array) -> None:
        lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
        offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
        self.data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        inside = _WORD[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = self.offsets[1:-1][self.offsets[1:-1] < len(self.data)]  # words end where texts do
        begins[cuts] = inside[cuts]
        self.source = np.flatnonzero(inside)
        begins = begins[self.source]
        word = np.cumsum(begins)
        self.place = np.arange(len(self.source)) + word - 1
        self.letters = np.full(len(self.source) + (int(word[-1]) if len(word) else 0), _SPACE, np.uint8)
        self.letters[self.place] = self.data[self.source]
        self.start = self.place[begins]
        self.first = np.searchsorted(self.source[begins], self.offsets)
        last = self.first[1:][np.diff(self.first) > 0] - 1
        self.letters[np.append(self.start[1:], len(self.letters))[last] - 1] = _STOP
        # From the place of its first word to its stop.
        bounds = np.append(self.start, len(self.letters))[self.first]
        self.low, self.high = bounds[:-1], np.maximum(bounds[1:] - 1, bounds[:-1])

    def text(self, a: int, b: int) -> str:
        """Letters a to b, moved outwards to whole code points."""
        while a > 0 and self.letters[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(self.letters) and self.letters[b] & 0xC0 == 0x80:
            b += 1
        return self.letters[a:b].tobytes().decode("utf-8", "replace")

    def points(self, text: int, a: int, b: int) -> tuple[int, int]:
        """Code points, in a text, of its letters a to b."""
        i, j = np.searchsorted(self.place, a), np.searchsorted(self.place, b) - 1
        lead = lambda s, e: int(((self.data[s:e] & 0xC0) != 0x80).sum())
        start = lead(self.offsets[text], self.source[i])
        return start, start + lead(self.source[i], self.source[j] + 1)


def normal(text: str | None) -> str:
    """The letters that a text is read as."""
    letters = Letters(pa.array([text], pa.large_string()))
    return letters.text(int(letters.low[0]), int(letters.high[0]))


def _drawn(walk: Walk, repetition: int) -> tuple[set[int], np.ndarray]:
    """Sampled places, and by step and letter whether the walk moves on; it stays at a stop."""
    rng = np.random.default_rng(SEED + repetition)
    places = {int((k + x) * walk.steps / walk.places) for k, x in enumerate(rng.random(walk.places))}
    moves = rng.integers(0, 2, (walk.steps, 256)).astype(np.int32)
    moves[:, _STOP] = 0
    return places, moves


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    """One of `slots` (a power of two) for each key."""
    return (_mix(key) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


@dataclass
class Windows:
    """Words at which windows start, their keys after `part` and all places, and the last letter that each reads."""

    word: np.ndarray
    part: np.ndarray
    part_last: np.ndarray
    whole: np.ndarray
    last: np.ndarray
    checked: np.ndarray


def window_keys(letters: Letters, walk: Walk, repetition: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> Windows:
    """Windows from each word on. known: slots of items' keys after CHECK and `part` places; a window in none is left."""
    places, moves = _drawn(walk, repetition)
    word, at, key = np.arange(len(letters.start)), letters.start.astype(np.int32), np.full(len(letters.start), np.uint64(repetition))
    checked = part = part_last = key
    read = 0
    for step in range(max(places) + 1):
        letter = letters.letters[at]
        if step in places:
            key = (key * _ODD) ^ (key >> np.uint64(29)) ^ letter
            read += 1
            if read in (CHECK, walk.part):
                if known is not None:
                    taken = known[read == walk.part]
                    keep = np.flatnonzero(taken[_slot(key, len(taken))])
                    word, at, key, letter, checked = word[keep], at[keep], key[keep], letter[keep], checked[keep]
                if read == CHECK:
                    checked = key
                else:
                    part, part_last = key, at
        if step < max(places):
            at = at + moves[step][letter]
    return Windows(word, part, part_last, key, at, checked)


def _sequences(letters: Letters, n: int) -> np.ndarray:
    """Hash of the n words from each word on; 0 where they reach beyond the text."""
    size = len(letters.start)
    if size < n:
        return np.zeros(size, np.uint64)
    length = np.diff(np.append(letters.start, len(letters.letters)))
    within = np.arange(len(letters.letters)) - np.repeat(letters.start, length)
    powers = np.multiply.accumulate(np.full(int(length.max()) + 1, _ODD))
    kept = np.where(letters.letters == _STOP, _SPACE, letters.letters).astype(np.uint64)
    word = _mix(np.add.reduceat(kept * powers[within], letters.start))
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out[: size - n + 1] = (out[: size - n + 1] * _ODD) ^ word[k : size - n + 1 + k]
    final = np.repeat(letters.first[1:], np.diff(letters.first))
    out[np.arange(size) + n > final] = 0
    return out


class Items:
    """One block of benchmark items with their window keys."""

    def __init__(self, ids: list, texts: list[str], similarity: float = SIMILARITY) -> None:
        self.ids = list(ids)
        self.letters = Letters(pa.array(texts, pa.large_string()))
        low, high, start = self.letters.low, self.letters.high, self.letters.start
        self.size = high - low
        self.norm = [self.letters.text(int(a), int(b)) for a, b in zip(low, high)]
        owner = np.repeat(np.arange(len(ids)), np.diff(self.letters.first))
        points = np.array([len(x) for x in self.norm], np.int64)
        self.points, self.limits = points, np.array([edit_limit(n, similarity) for n in points.tolist()], np.int64)
        #: Hits in line that a match can't do without, of items found by parts.
        self.needed = np.maximum(2, points // PART_LETTERS - self.limits)
        #: Bytes by which so many edits may put letters out of line.
        self.bytes_off = -(-self.limits * self.size // np.maximum(1, points))
        #: By walk and repetition: keys after `part` places, sorted; the whole key (its bits turned where it doesn't fit), item and offset.
        self.walks, self.keys, self.whole, self.item, self.offset, self.known = [], [], [], [], [], []
        ends = [*(w.least for w in WALKS[1:]), math.inf]
        for walk, r, end in [(w, r, e) for w, e in zip(WALKS, ends) for r in range(w.repetitions)]:
            of = (points >= walk.least) & (points < end)
            if not of.any():
                continue
            self.walks.append((walk, r))
            w = window_keys(self.letters, walk, r)
            within = np.flatnonzero((w.part_last < high[owner]) & of[owner])
            by = within[np.argsort(w.part[within], kind="stable")]
            self.keys.append(w.part[by])
            self.whole.append(np.where(w.last[by] < high[owner[by]], w.whole[by], ~w.whole[by]))
            self.item.append(owner[by])
            self.offset.append(start[by] - low[owner[by]])
            known = np.zeros((2, 1 << min(MOST_SLOTS, max(LEAST_SLOTS, (64 * len(within)).bit_length()))), bool)
            for taken, keys in zip(known, (w.checked, w.part)):
                taken[_slot(keys[within], len(taken))] = True
            self.known.append(tuple(known))
        self.parts = self._parts(np.flatnonzero((points >= WHOLE) & (points < EXACT)))
        #: Items found unchanged by their number of words: sorted hashes and whose they are.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        words = np.diff(self.letters.first)
        for n in np.unique(words[(points < WHOLE) & (words > 0)]).tolist():
            which = np.flatnonzero((words == n) & (points < WHOLE))
            keys = _sequences(self.letters, n)[self.letters.first[which]]
            by = np.argsort(keys, kind="stable")
            self.short[n] = keys[by], which[by]

    def _parts(self, which: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By number of letters, at most eight: sorted keys of items' parts, whose they are, and their offsets.

        An item that may have k edits is cut in n > k + 1 parts, so n - k at least are met unchanged, each no further
        out of line with the next than the edits between them.
        """
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i in which.tolist():
            text, n = self.norm[i], int(self.needed[i] + self.limits[i])
            cuts = [len(text) * j // n for j in range(n + 1)]
            for a, b in zip(cuts, cuts[1:]):
                letters = text[a:b].encode()[:8]
                found.setdefault(len(letters), []).append((int.from_bytes(letters, "little"), i, len(text[:a].encode())))
        return {n: tuple(np.array(c, k) for c, k in zip(zip(*sorted(rows)), (np.uint64, np.int64, np.int64))) for n, rows in found.items()}


def _postings(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of wanted, place in the sorted keys) of all equal pairs."""
    low = np.searchsorted(keys, wanted, side="left")
    n = np.searchsorted(keys, wanted, side="right") - low
    return np.repeat(np.arange(len(wanted)), n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


@lru_cache(maxsize=1 << 16)
def edit_limit(length: int, similarity: float) -> int:
    """Most edits that leave `similarity` or more of so many characters; exact, as 1 - 0.8 is not in floats."""
    return math.floor((1 - Fraction(str(similarity))) * length)


@lru_cache(maxsize=1 << 10)
def _masks(pattern: str) -> dict[str, int]:
    """Bits of the places of each letter."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(item: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of text nearest to item, if at most `most` edits away.

    Bit-parallel: the whole column of the edit table is one integer of len(item) bits.
    """
    place = text.find(item)
    if place >= 0:
        return 0, place, place + len(item)

    def ends(pattern: str, s: str, free_start: bool) -> tuple[int, int]:
        masks = _masks(pattern)
        full, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
        up, down, d = full, 0, len(pattern)
        found = (d, 0)
        for j, c in enumerate(s, 1):
            eq = masks.get(c, 0)
            x = eq | down
            h = (((eq & up) + up) ^ up) | eq
            plus, minus = down | (full & ~(h | up)), up & h
            d += (1 if plus & top else 0) - (1 if minus & top else 0)
            plus = plus << 1 & full | (0 if free_start else 1)
            minus = minus << 1 & full
            up, down = minus | (full & ~(x | plus)), plus & x
            if d < found[0]:
                found = (d, j)
        return found

    if not item:
        return None
    d, end = ends(item, text, True)
    if d > most:
        return None
    _, back = ends(item[::-1], text[:end][::-1], False)
    return d, end - back, end


def _hits(letters: Letters, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(item, offset in the item, place among the letters, whether it counts alone) of windows that collide and parts that are met."""
    for k, (walk, r) in enumerate(items.walks):
        w = window_keys(letters, walk, r, items.known[k])
        which, posting = _postings(items.keys[k], w.part)
        yield items.item[k][posting], items.offset[k][posting], letters.start[w.word[which]], items.whole[k][posting] == w.whole[which]
    packed, size = np.zeros(len(letters.letters), np.uint64), 0
    for n in sorted(items.parts):
        for size in range(size, n):  # keys of one letter more, where so many follow
            packed = packed[: len(letters.letters) - size] | letters.letters[size:].astype(np.uint64) << np.uint64(8 * size)
        size = n
        keys, item, offset = items.parts[n]
        met = np.zeros(1 << MOST_SLOTS, bool)
        met[_slot(keys, len(met))] = True
        at = np.flatnonzero(met[_slot(packed, len(met))])
        which, posting = _postings(keys, packed[at])
        yield item[posting], offset[posting], at[which], np.zeros(len(which), bool)


def _stretches(letters: Letters, items: Items) -> list[list[int]]:
    """(text, item, first, last): where among the letters the item may start, as far as its hits stand in line and count."""
    hits = list(zip(*_hits(letters, items)))
    if not hits or not sum(map(len, hits[0])):
        return []
    item, offset, place, alone = (np.concatenate(c) for c in hits)
    # The text of the window, not of the start, tells which text this is: the start may lie before the first letter.
    text, begin = np.searchsorted(letters.low, place, side="right") - 1, place - offset
    span = len(letters.letters) + int(items.size.max()) + 1
    by = np.argsort((text * len(items.ids) + item) * span + (begin + int(items.size.max())))
    item, offset, begin, alone, text = item[by], offset[by], begin[by], alone[by], text[by]
    by_parts, off = items.points[item] < EXACT, items.bytes_off[item]
    # Of a match by parts so many hits at least lie within as many bytes as its edits may put out of line.
    last = np.minimum(np.arange(len(item)) + items.needed[item] - 1, len(item) - 1)
    dense = by_parts & (text[last] == text) & (item[last] == item) & (begin[last] - begin <= off) & (last - np.arange(len(item)) == items.needed[item] - 1)
    covered = np.zeros(len(item) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(dense), 1)
    np.add.at(covered, last[dense] + 1, -1)
    kept = np.flatnonzero(~by_parts | (np.cumsum(covered[:-1]) > 0))
    if not len(kept):
        return []
    item, offset, begin, alone, text, by_parts, off = item[kept], offset[kept], begin[kept], alone[kept], text[kept], by_parts[kept], off[kept]
    # Hits of one text and item that are no further out of line than the edits allowed are one stretch.
    heads = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > off[1:])])
    tails = np.r_[heads[1:], len(item)] - 1
    apart = np.maximum.reduceat(offset, heads) - np.minimum.reduceat(offset, heads) >= APART
    counts = by_parts[heads] | np.logical_or.reduceat(alone, heads) | apart
    return np.c_[text[heads], item[heads], begin[heads], begin[tails]][counts].tolist()


def find_items(texts: pa.Array, items: Items) -> list[tuple]:
    """(text, item_id, start, end, distance, similarity) of each text's best match of each item."""
    return [(d, items.ids[i], *rest) for d, i, *rest in _found(texts, items)]


def _found(texts: pa.Array, items: Items) -> list[tuple[int, int, int, int, int, float]]:
    """The same with the item's number in the block."""
    letters = Letters(texts)
    if not len(letters.start) or not len(items.letters.start):
        return []
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for n, (keys, which) in items.short.items():
        at, posting = _postings(keys, _sequences(letters, n))
        for a, i in zip(letters.start[at].tolist(), which[posting].tolist()):
            size = int(items.size[i])
            d = int(np.searchsorted(letters.low, a, side="right")) - 1
            if (d, i) not in best and letters.text(a, a + size) == items.norm[i]:
                best[d, i] = 0, a, a + size
    for d, i, first, last in _stretches(letters, items):
        if best.get((d, i), (1,))[0] == 0:
            continue
        size, most = int(items.size[i]), int(items.limits[i])
        slack = int(items.bytes_off[i]) + SLACK
        low, high = max(int(letters.low[d]), first - slack), min(int(letters.high[d]), last + size + slack)
        text = letters.text(low, high)
        match = best_match(items.norm[i], text, most)
        if match and ((d, i) not in best or match[0] < best[d, i][0]):
            while low > 0 and letters.letters[low] & 0xC0 == 0x80:
                low -= 1
            before = len(text[: match[1]].encode())
            best[d, i] = match[0], low + before, low + before + max(1, len(text[match[1] : match[2]].encode()))
    return [(d, i, *letters.points(d, a, b), distance, 1 - distance / len(items.norm[i])) for (d, i), (distance, a, b) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the benchmark's items, BLOCK_BYTES at a time."""
    wanted = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").orderBy("item_id", "text")
    ids, texts, held = [], [], 0
    for r in wanted.toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"])
        if held >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns unchanged and none moved.

    Null and empty texts stay, all rows do without items; repeated rows share their fate. Very long texts are read
    whole. With more than one block of items, what each leaves is stored in the shared folder.
    """
    sc = docs.sparkSession.sparkContext

    def free_of(shared: Broadcast):  # noqa: ANN202
        @F.arrow_udf("boolean")
        def free(texts: pa.Array) -> pa.Array:
            out = np.ones(len(texts), bool)
            at = 0
            for part in by_bytes(pa.RecordBatch.from_arrays([texts], ["text"]), 0, SLICE_BYTES):
                out[[at + d for d, *_ in _found(part.column(0), shared.value)]] = False
                at += len(part)
            return pa.array(out)

        return free(F.col(text_col))

    left = None
    for ids, texts in _blocks(benchmark, item_col, item_text_col):
        # What one block leaves is stored before the next, so that no task holds two blocks.
        docs = docs if left is None else stored(left)
        left = docs.filter(free_of(sc.broadcast(Items(ids, texts, similarity))))
    return docs if left is None else left


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row and benchmark item found in it: doc_id, item_id, start, end, distance, similarity.

    start and end are code points of the best match. Null and empty texts and items without words match
    nothing; an item's id may be null or of any type; repeated rows of either side give repeated rows; empty
    tables give an empty result. Other columns are ignored. Items of fewer than WHOLE letters count where they stand
    unchanged, as whole words. Of several equally near parts of a text the first to end is told. Very long texts are
    read whole.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, item_kind = (given.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType)
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, start long, end long, distance int, similarity double"
    sc = docs.sparkSession.sparkContext
    out = docs.sparkSession.createDataFrame([], schema)
    names = out.columns
    types = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
    id_type = to_arrow_type(item_kind)
    for ids, texts in _blocks(benchmark, item_col, item_text_col):
        shared = sc.broadcast(Items(ids, texts, similarity))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            known = pa.array(shared.value.ids, id_type)
            for whole in batches:
                for batch in by_bytes(whole, 1, SLICE_BYTES):
                    columns = list(zip(*_found(batch.column(1), shared.value))) or [()] * 6
                    doc, item = (pa.array(c, pa.int64()) for c in columns[:2])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), known.take(item), *(pa.array(c, t) for c, t in zip(columns[2:], types))], names)

        out = out.union(given.mapInArrow(find, schema))
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
