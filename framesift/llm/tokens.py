"""Token counts of a text's sections, from one encoding of the whole text.

A byte-level vocabulary's tokens, put together, are the text's bytes, so the lengths of the tokens
give each token's span. Spans are joined to the sections' intervals by binary search over the sorted
section starts. A token that crosses a boundary goes to one section by an explicit rule:
`start`: the section of its first byte; `end`: of its last byte; `largest`: the one that holds most
of its bytes, the earlier on a tie. Counts of all sections, with those of no section, add up to
the text's tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "largest")
_ROW = "section int, name string, char_start long, char_end long, n_tokens long, n_crossing long"


@lru_cache(maxsize=2)
def encoder(ranks: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Encoding of a rank file's bytes, and each token's length in bytes."""
    table_ = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    lengths = np.zeros(max(table_.values()) + 1, np.int64)
    for token, rank in table_.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={}), lengths


def owners(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token, -1 for none; sections [a, b) are sorted and apart, some may be empty."""
    def at(x: np.ndarray) -> np.ndarray:
        # Of sections that start at one place, all but the last are empty.
        j = np.searchsorted(a, x, side="right") - 1
        return np.where((j >= 0) & (x < b[np.maximum(j, 0)]), j, -1) if len(a) else np.full(len(x), -1)

    first = at(starts)
    if rule == "start":
        return first
    last = at(ends - 1)
    if rule == "end":
        return last
    out = first.copy()
    # Tokens whose ends lie in different places, or in no section with one between them.
    between = np.searchsorted(a, ends, side="left") > np.searchsorted(b, starts, side="right")
    for i in np.flatnonzero((first != last) | ((first < 0) & between)):
        low = max(0, int(np.searchsorted(b, starts[i], side="right")))
        high = int(np.searchsorted(a, ends[i], side="left"))
        held = np.minimum(b[low:high], ends[i]) - np.maximum(a[low:high], starts[i])
        out[i] = low + int(held.argmax()) if len(held) and held.max() > 0 else -1
    return out


def count_sections(text: str, sections: Sequence[tuple[str | None, int, int]] | None, ranks: bytes, rule: str = "start") -> list[tuple]:
    """(section, name, char_start, char_end, n_tokens, n_crossing) of each section, by place.

    sections: (name, start, end) in code points, apart from each other; None: the text's lines, each
    with its line break. Tokens of no section make a last row of section -1 if there are any.
    n_crossing counts a section's tokens that reach beyond it.
    """
    encoding, lengths = encoder(ranks)
    data = np.frombuffer(text.encode(), np.uint8)
    begin = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # byte of each code point
    if sections is None:
        ends = (np.searchsorted(begin, np.flatnonzero(data == 10)) + 1).tolist()
        ends += [] if ends and ends[-1] == len(text) else [len(text)]
        sections = [(None, s, e) for s, e in zip([0, *ends[:-1]], ends)]
    order = sorted(range(len(sections)), key=lambda i: (sections[i][1], sections[i][2], i))
    a = begin[np.clip([sections[i][1] for i in order], 0, len(text))] if order else np.zeros(0, np.int64)
    b = begin[np.clip([sections[i][2] for i in order], 0, len(text))] if order else np.zeros(0, np.int64)
    stops = np.cumsum(lengths[encoding.encode_to_numpy(text, disallowed_special=())]) if text else np.zeros(0, np.int64)
    starts = np.r_[0, stops[:-1]] if len(stops) else stops
    own = owners(starts, stops, a, b, rule)
    counts = np.bincount(own + 1, minlength=len(order) + 1)
    inside = own >= 0
    over = inside & ((starts < a[np.maximum(own, 0)]) | (stops > b[np.maximum(own, 0)])) if len(order) else inside
    crossing = np.bincount(own[over] + 1, minlength=len(order) + 1)
    rows = [(k, sections[i][0], sections[i][1], sections[i][2], int(counts[k + 1]), int(crossing[k + 1])) for k, i in enumerate(order)]
    return rows + ([(-1, None, None, None, int(counts[0]), 0)] if counts[0] else [])


def with_fields(df: DataFrame, id_col: str, fields: Sequence[str], separator: str = "\n") -> DataFrame:
    """doc_id, text, sections: fields joined by a separator, with their places; null fields are empty."""
    value = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields}
    at, spans = F.lit(0).cast("long"), []
    for f in fields:
        end = at + F.char_length(value[f])
        spans.append(F.struct(F.lit(f).alias("name"), at.alias("start"), end.alias("end")))
        at = end + len(separator)
    return df.select(F.col(id_col).alias("doc_id"), F.concat_ws(separator, *value.values()).alias("text"), F.array(*spans).alias("sections"))


def count_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
    rule: str = "start",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """One row per section of each input row: doc_id, section, name, char_start, char_end, n_tokens, n_crossing.

    Very long texts are encoded whole, one at a time; a token that lies equally in two sections goes by the rule.
    Without sections_col, sections are lines. Null and empty texts have one empty line of 0 tokens;
    with sections_col, a null list has no sections. Repeated rows give repeated rows; an empty table
    gives an empty result. Other columns are ignored. The vocabulary file is read on the driver.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    chosen = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    given = docs.select(*chosen, *([F.col(sections_col).alias("sections")] if sections_col else []))
    kind = given.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                which, rows = [], []
                listed = batch.column(2).to_pylist() if sections_col else [None] * len(batch)
                for i, (text, sections) in enumerate(zip(batch.column(1).to_pylist(), listed)):
                    spans = [(s["name"], s["start"], s["end"]) for s in sections or []] if sections_col else None
                    found = count_sections(text, spans, ranks.value, rule)
                    rows += found
                    which += [i] * len(found)
                columns = list(zip(*rows)) or [()] * 6
                types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in _ROW.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *names])

    return given.mapInArrow(count, f"doc_id {kind}, {_ROW}")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def page_field_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each page's fields, its address and its source put together, each token going where most of it lies."""
    fields = with_fields(table(spark, sf_dir, "pages"), "page_id", ["url", "html"])
    return count_tokens(fields, sections_col="sections", rule="largest").withColumnRenamed("doc_id", "page_id")
