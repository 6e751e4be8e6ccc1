"""Document quality from a linear-chain conditional random field over lines.

Every line (\\n-split) is labelled good or bad. A line's potentials are linear in its own statistics
and in those of the lines before and after it; a two-by-two table couples neighbouring labels. A
document's quality is the mean of its lines' marginal probabilities of being good, by the
forward-backward recursions, weighted by the lines' lengths.

Training: labels are known of documents, not of lines, so the lines' labels are learned with the field
(hard expectation maximisation). Lines begin with their document's label, and a first fit reads each line
alone, as whole chains of one label would say only that labels repeat; after each fit, the lines whose
marginals speak most clearly against their document's label change sides, for as long as their document's length-weighted share of
good lines still agrees with its label. Learned from are at most TRAIN_DOCS labelled documents of up to
TRAIN_BYTES and TRAIN_LINES each (the first by a hash of the id); the conditional likelihood with an L2 term is climbed on the
driver, whose data are those documents' line statistics only. Scoring is one pass over all texts without shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, crc_fold, table, thinned

#: Labelled documents that are learned from: so many, of up to so many bytes.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_LINES = 4000, 1 << 18, 512
STEPS, RATE, RIDGE = 120, 0.1, 1e-3
GOOD_FROM = 0.7
#: Times that lines are labelled anew; a good document keeps this share of good lines at least, a bad one
#: has at most that; a line changes sides if its marginal is this far on the other side.
ROUNDS, GOOD_SHARE, BAD_SHARE, CLEAR = 2, 0.9, 0.3, 0.6
#: Byte classes counted in each line.
_CLASSES = (
    ("lower", b"abcdefghijklmnopqrstuvwxyz"),
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("digit", b"0123456789"),
    ("space", b" \t\x0b\x0c\r"),
    ("symbol", b"#*$%&|<>{}[]\\^~=+@_/"),
    ("shout", b"!?"),
    ("stop", b".,;:"),
)
FEATURES = 13


def line_statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, each line's weight in bytes, and where each text's lines start.

    Null texts count as empty; an empty text is one empty line.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    breaks = np.flatnonzero(buffer == 10)
    # A line starts at each text's start and behind each break inside a text.
    starts = np.concatenate([offsets[:-1], breaks + 1])
    of = np.concatenate([np.arange(len(texts)), np.searchsorted(offsets, breaks, side="right") - 1])
    by = np.lexsort((starts, of))
    starts, of = starts[by], of[by]
    first = np.searchsorted(of, np.arange(len(texts)))
    last = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
    ends = np.where(last, offsets[of + 1], np.r_[starts[1:] - 1, 0])
    length = ends - starts
    full = np.flatnonzero(length > 0)
    counts = np.zeros((len(starts), len(_CLASSES) + 1))
    if len(full):
        edges = np.stack([starts[full], ends[full]], axis=1).ravel()
        edges = edges[:-1] if edges[-1] == len(buffer) else edges
        for k, (_, members) in enumerate(_CLASSES):
            lut = np.zeros(256, np.int32)
            lut[list(members)] = 1
            counts[full, k] = np.add.reduceat(lut[buffer], edges)[::2]
        gap = np.zeros(256, bool)
        gap[list(b" \t\n\x0b\x0c\r")] = True
        begins = ~gap[buffer]
        begins[1:] &= gap[buffer[:-1]]
        begins[starts[full]] |= ~gap[buffer[starts[full]]]
        counts[full, -1] = np.add.reduceat(begins.astype(np.int32), edges)[::2]
    lower, upper, digit, space, symbol, shout, stop, words = counts.T
    n, letters = np.maximum(words, 1), np.maximum(lower + upper, 1)
    seen, again, different = np.zeros(len(starts)), np.zeros(len(starts)), np.ones(len(starts))
    raw = buffer.tobytes()
    for a, b in zip(first, np.r_[first[1:], len(starts)]):
        known: set[bytes] = set()
        for i in range(a, b):
            line = raw[starts[i] : ends[i]]
            seen[i] = bool(line) and line in known
            known.add(line)
            if own := line.split():
                again[i] = sum(map(eq, own, own[1:])) / len(own)
                different[i] = len(set(own)) / len(own)
    features = np.stack([
        np.minimum(symbol / n, 3), np.minimum(shout / n, 3), upper / letters, digit / np.maximum(length, 1), np.minimum(stop / n, 2),
        np.minimum((length - space) / n, 30) / 10, np.log1p(words) / 5, (words == 0).astype(float), seen, (symbol > 0.3 * n).astype(float), (upper > 0.5 * letters).astype(float),
        again, different,
    ], axis=1)
    return features, length + 1.0, first


def with_neighbours(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, marks for a missing neighbour, and a constant."""
    n = len(features)
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[first] = True
    tail[np.r_[first[1:], n] - 1] = True
    before, after = np.roll(features, 1, axis=0), np.roll(features, -1, axis=0)
    before[head], after[tail] = 0, 0
    return np.concatenate([features, before, after, head[:, None], tail[:, None], np.ones((n, 1))], axis=1)


@dataclass
class Chain:
    """weights: log odds of good by features. couple[a, b]: log potential of labels a, b side by side."""

    weights: np.ndarray
    couple: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and the expected label pairs of all neighbouring lines (summed)."""
        n, counts = len(x), np.diff(np.r_[first, len(x)])
        unary = np.stack([np.zeros(n), x @ self.weights], axis=1)
        forward, backward = unary.copy(), np.zeros((n, 2))
        order = np.argsort(-counts, kind="stable")
        steps = [order[: np.searchsorted(-counts[order], -t, side="left")] for t in range(1, counts.max(initial=0))]
        for t, texts in enumerate(steps, 1):  # all texts with a line t at once
            i = first[texts] + t
            forward[i] += np.logaddexp(forward[i - 1, :1] + self.couple[0], forward[i - 1, 1:] + self.couple[1])
        for t in range(len(steps), 0, -1):
            i = first[steps[t - 1]] + t
            right = unary[i] + backward[i]
            backward[i - 1] = np.logaddexp(self.couple[:, 0] + right[:, :1], self.couple[:, 1] + right[:, 1:])
        z = forward + backward
        good = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))
        inner = np.ones(n, bool)
        inner[first] = False
        i = np.flatnonzero(inner)
        pairs = forward[i - 1][:, :, None] + self.couple + (unary[i] + backward[i])[:, None, :]
        pairs = np.exp(pairs - pairs.max(axis=(1, 2), keepdims=True)) if len(i) else np.zeros((0, 2, 2))
        return good, (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        features, weight, first = line_statistics(texts)
        good, _ = self.marginals(with_neighbours(features, first), first)
        return np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0, 1)


def relabelled(good: np.ndarray, weight: np.ndarray, first: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Lines' labels from their marginals: their document's, but for the clearest lines of the other label,
    as far as the document's share of good lines allows."""
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(good)]))
    own = labels[of].astype(float)
    against = np.where(own == 1, 1 - good, good)
    by = np.lexsort((np.arange(len(good)), -against, of))
    share = weight[by] / np.add.reduceat(weight, first)[of[by]]
    total = np.cumsum(share)
    moved = total - np.repeat(total[first] - share[first], np.diff(np.r_[first, len(good)]))
    room = np.where(own[by] == 1, 1 - GOOD_SHARE, BAD_SHARE)
    turned = by[(against[by] >= CLEAR) & (moved <= room + 1e-9)]
    own[turned] = 1 - own[turned]
    return own


def fit(features: np.ndarray, weight: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Chain:
    """Field of documents with a label each: fits in turn with labelling their lines."""
    x = with_neighbours(features, first)
    y = np.repeat(labels, np.diff(np.r_[first, len(x)])).astype(float)
    size = x.shape[1]
    alone = np.r_[np.arange(size) < features.shape[1], np.zeros(4, bool)]
    alone[size - 1] = True
    chain = climbed(x, first, y, Chain(np.zeros(size), np.zeros((2, 2))), alone)
    for _ in range(ROUNDS):
        y = relabelled(chain.marginals(x, first)[0], weight, first, labels)
        chain = climbed(x, first, y, chain, np.ones(size + 4, bool))
    return chain


def climbed(x: np.ndarray, first: np.ndarray, y: np.ndarray, chain: Chain, free: np.ndarray) -> Chain:
    """Adam steps on the conditional log likelihood of the lines' labels y, by the free parameters."""
    seen = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[first] = False
    i = np.flatnonzero(inner)
    np.add.at(seen, (y[i - 1].astype(int), y[i].astype(int)), 1)
    size = x.shape[1]
    m, v = np.zeros(size + 4), np.zeros(size + 4)
    chain = Chain(chain.weights, chain.couple)
    for step in range(1, STEPS + 1):
        good, pairs = chain.marginals(x, first)
        gradient = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(first)
        gradient -= RIDGE * np.concatenate([chain.weights, chain.couple.ravel()])
        gradient *= free
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        chain.weights = chain.weights + move[:size]
        chain.couple = chain.couple + move[size:].reshape(2, 2)
    return chain


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Chain:
    """Field of the labelled documents; without any, every line is good at one half.

    Labels that are null or neither 0 nor 1, null ids, and labelled texts over TRAIN_BYTES or TRAIN_LINES say nothing; a null
    text is one empty line; rows that repeat a label count each; other columns are ignored.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    sample = thinned(marks, F.xxhash64("id"), most).orderBy(F.xxhash64("id"), "id", "label").limit(most)
    # `most` rows at most: the hint's bound.
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("label", "text")
    text = F.coalesce("text", F.lit(""))
    picked = picked.filter((F.octet_length(text) <= TRAIN_BYTES) & (F.length(text) - F.length(F.replace(text, F.lit("\n"))) < TRAIN_LINES))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                features, weight, first = line_statistics(batch.column(1))
                each = np.split(np.c_[features, weight], first[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.astype("<f4").tobytes() for f in each], pa.binary())], ["label", "features"])

    rows = picked.mapInArrow(measure, "label int, features binary").collect()
    if not rows:
        return Chain(np.zeros(3 * FEATURES + 3), np.zeros((2, 2)))
    rows.sort(key=lambda r: (r["label"], bytes(r["features"])))
    each = [np.frombuffer(r["features"], "<f4").reshape(-1, FEATURES + 1).astype(float) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(f) for f in each])[:-1]])
    lines = np.concatenate(each)
    return fit(lines[:, :-1], lines[:, -1], first, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text", good_from: float = GOOD_FROM) -> DataFrame:
    """One row per input row: doc_id, score, predicted.

    Null and empty texts are scored as one empty line; repeated rows give repeated rows; an empty
    table gives an empty result. A score at the threshold is good. Very long texts are read whole, their lines as
    one chain. Other columns are ignored, whatever their names.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], ["doc_id", "score"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(apply, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= good_from).cast("int"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, table(spark, sf_dir, "labels").filter(crc_fold(F.col("doc_id"), 4) != 2))
    return score(docs, chain).select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
