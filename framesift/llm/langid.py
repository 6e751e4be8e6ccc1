"""Language identification by interpolated Kneser-Ney character models, one per language.

A text's words (runs without white space, lower-cased, letters only) are modelled letter by letter
with up to three letters of context inside the word. For every n-gram that any language has seen,
sorted hash arrays hold the interpolated log probability under every language, so one binary search
serves all languages; unseen n-grams go down to shorter ones with the context's back-off weight.
The language of lowest cross-entropy per letter wins; a text whose best cross-entropy lies beyond
what held-back training texts of that language show is rejected.

Training: at most DOCS_PER_LANGUAGE labelled texts a language, and BYTES_PER_LANGUAGE of them, the first by a hash of the id. Counts
are made by Spark; the model's arrays are as large as the sample's distinct n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, crc_fold, small, table

ORDER = 4
DOCS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 1000, 4 << 20
#: One in so many sampled texts calibrates instead of training.
CALIBRATE_EVERY = 5
#: Accepted up to this factor times the calibration texts' quantile of cross-entropy.
REJECT_QUANTILE, REJECT_FACTOR = 0.995, 1.5
UND = "und"
#: Bytes of text that are scored at once.
SLICE_BYTES = 1 << 20
#: Symbols that are looked up at once.
CHUNK = 1 << 15
_START, _END = "\x02", "\x03"


def _word_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each behind ORDER - 1 start marks and before an end mark, and each
    word's number of predicted symbols (letters and the end mark; 0 without letters)."""
    letters = pc.replace_substring_regex(words, pattern=r"[^\p{L}]+", replacement="")
    n = pc.utf8_length(letters).to_numpy(zero_copy_only=False).astype(np.int64)
    text = _START * (ORDER - 1) + (_END + _START * (ORDER - 1)).join(letters.to_pylist()) + _END
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), np.where(n > 0, n + 1, 0)


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position from ORDER - 1 on."""
    base = ORDER - 1
    h = np.full(len(codes) - base, np.uint64(order))
    for k in range(order - 1, -1, -1):
        h = (h ^ codes[base - k : len(codes) - k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words, each occurrence's word, and where each text's occurrences start."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    words = pc.dictionary_encode(lists.flatten())
    starts = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False), starts - starts[0]


@dataclass
class KneserNey:
    """For orders 1..ORDER: sorted n-gram hashes with log probabilities of each language (NaN where a
    language has not seen it at this order), and sorted context hashes with log back-off weights."""

    languages: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def symbol_scores(self, codes: np.ndarray) -> np.ndarray:
        """log P of each position from ORDER - 1 on, under each language."""
        n = len(codes) - ORDER + 1
        out, weight = np.full((n, len(self.languages)), np.nan), np.zeros((n, len(self.languages)))
        open_ = np.arange(n)
        for order in range(ORDER, 0, -1):
            keys = _grams(codes, order)[open_]
            at = np.minimum(np.searchsorted(self.grams[order], keys), len(self.grams[order]) - 1)
            found = (self.grams[order][at] == keys)[:, None]
            fresh = np.where(found & np.isnan(out[open_]), self.logp[order][at] + weight[open_], np.nan)
            out[open_] = np.where(np.isnan(out[open_]), fresh, out[open_])
            open_ = open_[np.isnan(out[open_]).any(axis=1)]
            if not len(open_):
                return out
            keys = _grams(np.append(codes[:1], codes), order - 1)[open_]  # the context ends one place before
            at = np.minimum(np.searchsorted(self.contexts[order], keys), len(self.contexts[order]) - 1)
            weight[open_] += np.where((self.contexts[order][at] == keys)[:, None], self.backoff[order][at], 0.0)
        return np.where(np.isnan(out), self.floor + weight, out)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """symbol_scores, CHUNK positions at a time."""
        parts = [self.symbol_scores(codes[a : a + CHUNK + ORDER - 1]) for a in range(0, len(codes) - ORDER + 1, CHUNK)]
        return np.concatenate(parts)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text under each language, and its number of symbols."""
        words, which, starts = _split(texts)
        total, symbols = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        if not len(words):
            return total, symbols
        codes, n = _word_codes(words)
        scores = self.scores(codes)
        predicted = codes[ORDER - 1 :] != ord(_START)
        scores[~predicted] = 0
        ends = np.cumsum(np.where(n > 0, n - 1, 0) + ORDER)  # each word takes its letters, an end mark and the next start marks
        by_word = np.add.reduceat(scores, np.concatenate([[0], ends[:-1]]), axis=0)
        by_word[n == 0] = 0
        full = np.flatnonzero(np.diff(starts) > 0)
        total[full] = np.add.reduceat(by_word[which], starts[full], axis=0)
        symbols[full] = np.add.reduceat(n[which], starts[full])
        return -total / np.maximum(symbols, 1)[:, None], symbols


def _estimate(rows: list[tuple[str, str, int]]) -> KneserNey:
    """Interpolated Kneser-Ney from counts of full n-grams (language, n-gram of ORDER symbols, count)."""
    full: dict[str, dict[str, int]] = {}
    for language, gram, n in rows:
        full.setdefault(language, {})[gram] = n
    languages = sorted(full)
    tables: list[list[dict[str, float]]] = []
    for language in languages:
        counts: list[dict[str, int]] = [{} for _ in range(ORDER)] + [full[language]]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: how many different symbols stand before
            for g in counts[order + 1]:
                counts[order][g[1:]] = counts[order].get(g[1:], 0) + 1
        tables.append(counts)
    symbols = len({g[-1] for counts in tables for g in counts[ORDER]}) + 1
    probabilities: list[list[dict[str, float]]] = []
    weights: list[list[dict[str, float]]] = []
    for counts in tables:
        p: list[dict[str, float]] = [{"": 1.0 / symbols}] + [{} for _ in range(ORDER)]
        w: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
        for order in range(1, ORDER + 1):
            ones = sum(1 for n in counts[order].values() if n == 1)
            twos = sum(1 for n in counts[order].values() if n == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            sums: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for g, n in counts[order].items():
                sums[g[:-1]] = sums.get(g[:-1], 0) + n
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            w[order] = {c: discount * kinds[c] / sums[c] for c in sums}
            for g, n in counts[order].items():
                lower = p[order - 1].get(g[1:], 0.0) if order > 1 else p[0][""]
                p[order][g] = max(n - discount, 0) / sums[g[:-1]] + w[order][g[:-1]] * lower
        probabilities.append(p)
        weights.append(w)

    def hashes(grams: list[str], order: int) -> np.ndarray:
        text = "".join(g.rjust(ORDER, _START) for g in grams)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, ORDER)
        return np.array([], np.uint64) if not grams else _grams(codes.reshape(-1), order)[:: ORDER]

    model = KneserNey(languages, [np.array([0], np.uint64)], [np.zeros((1, len(languages)))], [np.array([0], np.uint64)], [np.zeros((1, len(languages)))], float(np.log(1.0 / symbols)))
    for order in range(1, ORDER + 1):
        for source, keys_out, values_out, width in ((probabilities, model.grams, model.logp, order), (weights, model.contexts, model.backoff, order - 1)):
            every = sorted(set().union(*(t[order] for t in source)))
            keys = hashes(every, width)
            values = np.array([[np.log(t[order][g]) if g in t[order] else (np.nan if source is probabilities else 0.0) for t in source] for g in every])
            by = np.argsort(keys)
            keys_out.append(keys[by])
            values_out.append(values[by])
    return model


def _labelled(docs: DataFrame, per_language: int) -> DataFrame:
    """A bounded sample: the first rows of each language by a hash of the id and the text.

    Rows are first thinned by that hash to about twice what is wanted of each language, so that the
    ranking sees a bounded number of texts however many there are.
    """
    known = docs.filter("lang IS NOT NULL").select("lang", "text", F.xxhash64(F.col("id").cast("string")).alias("pick"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    span = 1 << 63
    bounds = [(r["lang"], min(span - 1, -span + 2 * span * 2 * per_language // r["n"])) for r in counts]
    thin = known.join(small(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"), len(bounds)), "lang").filter("pick <= bound AND text IS NOT NULL")
    pick = Window.partitionBy("lang").orderBy("pick", "text")
    held = F.sum(F.octet_length("text")).over(pick.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return thin.withColumn("rank", F.row_number().over(pick)).withColumn("held", held).filter((F.col("rank") <= per_language) & (F.col("held") <= BYTES_PER_LANGUAGE))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> KneserNey | None:
    """Model of the labelled texts of docs; None if there are none with letters.

    Null languages and null texts say nothing, empty ones add nothing; rows that repeat count each, up to the
    sample's bound; other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = _labelled(named, per_language).withColumn("calibrates", F.pmod("pick", F.lit(CALIBRATE_EVERY)) == 0).select("lang", "text", "calibrates").persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                langs = np.array(batch.column(0).to_pylist())
                for lang in np.unique(langs):
                    words, which, _ = _split(batch.column(1).filter(pa.array(langs == lang)))
                    grams: dict[str, int] = {}
                    for word, n in zip(pc.replace_substring_regex(words, pattern=r"[^\p{L}]+", replacement="").to_pylist(), np.bincount(which, minlength=len(words))):
                        if word:
                            padded = _START * (ORDER - 1) + word + _END
                            for i in range(len(word) + 1):
                                grams[padded[i : i + ORDER]] = grams.get(padded[i : i + ORDER], 0) + int(n)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(list(grams), pa.string()), "n": pa.array(list(grams.values()), pa.int64())})

    rows = sample.filter("NOT calibrates").select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    if not rows:
        sample.unpersist()
        return None
    model = _estimate([tuple(r) for r in rows])
    held = _entropies(sample.filter("calibrates").select("lang", "text"), model).collect()
    # A language none of whose texts were held back is calibrated by those that trained it.
    bare = sorted(set(model.languages) - {r["lang"] for r in held if r["symbols"]})
    if bare:
        held += _entropies(sample.filter(F.col("lang").isin(bare) & ~F.col("calibrates")).select("lang", "text"), model).collect()
    sample.unpersist()
    k = len(model.languages)
    model.limits = np.full(k, np.inf)
    truth = np.array([model.languages.index(r["lang"]) if r["lang"] in model.languages else -1 for r in held])
    entropy = np.array([r["entropy"] for r in held]).reshape(-1, k)
    seen = np.array([r["symbols"] for r in held]) > 0 if held else np.zeros(0, bool)
    for i in range(k):
        own = entropy[(truth == i) & seen]
        if len(own):
            model.limits[i] = REJECT_FACTOR * np.quantile(own[:, i], REJECT_QUANTILE)
    use = seen & (truth >= 0)
    if use.any():
        def loss(t: float) -> float:
            z = -t * entropy[use]
            z -= z.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth[use]]))

        model.temperature = min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=loss)
    return model


def _entropies(frame: DataFrame, model: KneserNey) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1, SLICE_BYTES):
                entropy, symbols = shared.value.texts(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(symbols)], ["lang", "entropy", "symbols"])

    return frame.mapInArrow(score, "lang string, entropy array<double>, symbols long")


def _judge(model: KneserNey | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy (NaN without letters) and acceptance of each text."""
    n = len(texts)
    lang, p, best, ok = np.full(n, UND, object), np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
    if model is not None:
        entropy, symbols = model.texts(texts)
        first = entropy.argmin(axis=1)
        z = np.exp(-model.temperature * (entropy - entropy.min(axis=1, keepdims=True)))
        some = symbols > 0
        best[some] = entropy[np.arange(n), first][some]
        lang[some] = np.array(model.languages, object)[first[some]]
        p[some] = (1 / z.sum(axis=1))[some]
        ok = some & (best <= model.limits[first])
    return lang, p, best, ok


def identify(docs: DataFrame, model: KneserNey | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, entropy, accepted; one row per input row.

    Null texts, texts without a letter, and all texts without a model are `und` with score 0, not
    accepted. Of languages with equal entropies the first by name is told. Very long texts are read whole, a chunk of
    their words at a time. Repeated rows give repeated rows; an empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1, SLICE_BYTES):
                lang, p, best, ok = _judge(shared.value, batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(p), pa.array(best, from_pandas=True), pa.array(ok)], ["doc_id", "lang_pred", "score", "entropy", "accepted"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double, entropy double, accepted boolean")


def accepted(docs: DataFrame, model: KneserNey | None, *, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text the model accepts, all columns unchanged; texts do not leave the JVM twice.

    Null texts and texts without a letter go, and all rows without a model; repeated rows share their fate; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [_judge(shared.value, part.column(0))[3] for part in by_bytes(batch, 0, SLICE_BYTES)]
        return pa.array(np.concatenate([*parts, np.zeros(0, bool)]))

    return docs.filter(passes(F.col(text_col)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    model = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "entropy", "accepted")
