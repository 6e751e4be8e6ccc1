"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

Three patterns give the base spans (assignments, access keys, hexadecimal tokens). Their values, as
labelled credentials of a kind each, train one probabilistic automaton a kind by state merging: a
prefix tree, its states folded in breadth-first order into the first kept state whose outgoing
frequencies (and, recursively, whose successors') agree within the Hoeffding bound.

The automata read formats. A credential's first symbol is the least alphabet that holds its letters and digits
(of either case, hexadecimal or not); then come its characters: punctuation and the letters of a prefix
that many of the kind share as themselves, all others as one symbol, whose character is as likely as any of
the alphabet. So prefixes, lengths and places of punctuation make states, random characters don't.

Every candidate token of every text (a run of credential characters, LEAST_FORMAT or more) is then scored
whole: its log likelihood under each automaton, the probability to end there included, against that of
ordinary tokens, which it must outweigh by more than that kind is rarer than tokens are. Such tokens are added
as spans. A bound on the score, from the token's alphabet and length, is told for all tokens at once; only
those that it leaves open are run through the automata.

Ordinary tokens' statistics, how often each class (or the end) follows the CONTEXT classes before it, and the numbers
of tokens and credentials are counted over all tokens of all texts. Only the labelled credentials that make the
trees are a sample: CREDENTIALS_PER_KIND values a kind, the first by hash, of up to LONGEST characters each.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, stored, table

KINDS = ("assign", "access", "hex")
ADDED = "format"
#: Fixed patterns of the base spans, with the least length of what they must hold.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Characters of candidate tokens, and the least length of a candidate.
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
LEAST_FORMAT = 6
#: A prefix of up to so many characters is read as itself if so large a share of a kind's values, and so many, have it.
PREFIX, PREFIX_SHARE, PREFIX_LEAST = 12, 0.2, 8
#: Labelled credentials that are learned from: so many a kind, of up to so many characters.
CREDENTIALS_PER_KIND, LONGEST = 2000, 128
SLOTS = 20
#: Hoeffding bound's confidence.
ALPHA = 0.05
PLACEHOLDER = "[SECRET]"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, kinds in order, by start inside a kind."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def credentials(text: str) -> Iterator[tuple[str, str]]:
    """Labelled credentials: the value of each base span."""
    for kind, start, end in base_spans(text):
        yield kind, ASSIGN.match(text[start:end])[1] if kind == "assign" else text[start:end]


def symbol(c: str) -> str:
    """Character class: hexadecimal letters stand apart, and so do the cases."""
    if "0" <= c <= "9":
        return "9"
    if "a" <= c <= "z":
        return "a" if c <= "f" else "z"
    return ("A" if c <= "F" else "Z") if "A" <= c <= "Z" else "-"


SYMBOLS = 6
#: Number of each class in the background's counts; 0 stands for the token's start and its end. Characters of a class.
_NUMBER = {s: i for i, s in enumerate("9azAZ-", 1)}
_CHARS = np.array([1, 10, 6, 20, 6, 20, 5])
_CLASS = np.zeros(129, np.int64)
for _c in sorted(TOKEN):
    _CLASS[ord(_c)] = _NUMBER[symbol(_c)]
#: Classes before one that tell its probability in ordinary tokens.
CONTEXT = 3
_SIZE = SYMBOLS + 1

#: Alphabets by the classes that a token has (a bit each), and how many characters they hold.
ALPHABETS = {"none": 1, "digits": 10, "hex": 16, "HEX": 16, "lower": 26, "UPPER": 26, "lower9": 36, "UPPER9": 36, "mixed": 52, "mixed9": 62}
_9, _A, _Z, _UA, _UZ = (1 << i for i in range(1, 6))


def _alphabet(bits: int) -> str:
    low, up, digits = bits & (_A | _Z), bits & (_UA | _UZ), bits & _9
    if low and up:
        return "mixed9" if digits else "mixed"
    if not low and not up:
        return "digits" if digits else "none"
    if not bits & (_Z | _UZ):
        return "hex" if low else "HEX"
    return ("lower" if low else "UPPER") + ("9" if digits else "")


_ALPHABET = [_alphabet(bits) for bits in range(1 << _SIZE)]
_NAMES = list(ALPHABETS)
_ALPHABET_NO = np.array([_NAMES.index(a) for a in _ALPHABET])
#: What stands for any character of the alphabet.
ANY = "any"
#: Symbols that probabilities are smoothed over: alphabets, characters, any of them, the end.
_SMOOTHED = len(ALPHABETS) + len(TOKEN) + 2


def classes(text: str) -> np.ndarray:
    """Class of each code point of a text, 0 for those that no token has."""
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def tokens(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of credential characters."""
    inside = np.diff(np.concatenate([[0], (code > 0).astype(np.int8), [0]]))
    return np.flatnonzero(inside > 0), np.flatnonzero(inside < 0)


def _contexts(code: np.ndarray) -> np.ndarray:
    """Number of the classes before each place, and before the end; a context does not reach beyond its token's start."""
    padded = np.concatenate([np.zeros(CONTEXT, np.int64), code])
    key, inside = np.zeros(len(code) + 1, np.int64), np.ones(len(code) + 1, bool)
    for k in range(1, CONTEXT + 1):
        before = padded[CONTEXT - k : len(padded) - k + 1]
        inside &= before > 0
        key += np.where(inside, before, 0) * _SIZE ** (k - 1)
    return key


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the tokens of LEAST_FORMAT characters or more."""
    starts, ends = tokens(classes(text))
    long_ = ends - starts >= LEAST_FORMAT
    return zip(starts[long_].tolist(), ends[long_].tolist())


@dataclass
class Background:
    """Ordinary tokens: how often each class, or the end (class 0), follows each context, and the number of tokens."""

    counts: np.ndarray = field(default_factory=lambda: np.zeros((_SIZE**CONTEXT, _SIZE), np.int64))
    tokens: int = 0

    def add(self, text: str) -> None:
        """Counts all tokens of a text."""
        code = classes(text)
        starts, ends = tokens(code)
        key, now = _contexts(code), np.append(code, 0)
        some = now > 0
        some[ends] = True
        self.counts += np.bincount(key[some] * _SIZE + now[some], minlength=self.counts.size).reshape(self.counts.shape)
        self.tokens += len(starts)

    def logs(self) -> np.ndarray:
        """Log probability of a character, or the end, by context and class; smoothed by one count spread over the classes."""
        return (np.log((self.counts + 1 / _SIZE) / (self.counts.sum(axis=1, keepdims=True) + 1)) - np.log(_CHARS)).ravel()


@dataclass
class Automaton:
    """States with how often they are entered, left by each symbol, and ended in; the prefixes read as themselves."""

    go: list[dict[str, int]] = field(default_factory=lambda: [{}])
    left: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ended: list[int] = field(default_factory=lambda: [0])
    prefixes: frozenset[str] = frozenset()

    def total(self, q: int) -> int:
        return self.ended[q] + sum(self.left[q].values())

    def log_likelihood(self, word: str) -> float:
        """Log probability of the word and its end, smoothed by one count spread over the symbols."""
        q, out = 0, 0.0
        symbols = read(word, self.prefixes)
        share = -math.log(ALPHABETS[symbols[0]])
        for s in symbols:
            if q < 0:
                out += share - math.log(_SMOOTHED)
                continue
            out += math.log((self.left[q].get(s, 0) + 1 / _SMOOTHED) / (self.total(q) + 1)) + (share if s == ANY else 0)
            # Behind an alphabet that no credential has, the commonest one's format goes on.
            q = self.go[q].get(s, -1 if q or not self.go[0] else self.go[0][max(self.left[0], key=lambda a: (self.left[0][a], a))])
        return out + (math.log((self.ended[q] + 1 / _SMOOTHED) / (self.total(q) + 1)) if q >= 0 else -math.log(_SMOOTHED))

    def best(self) -> np.ndarray:
        """By alphabet, the most that a word's likelihood can be beside that of its characters."""
        return np.array([math.log((self.left[0].get(a, 0) + 1 / _SMOOTHED) / (self.total(0) + 1)) for a in _NAMES])


def common_prefixes(words: list[str]) -> frozenset[str]:
    """Prefixes that many of the words share, none longer than PREFIX."""
    counts = Counter(w[:k] for w in words for k in range(1, min(PREFIX, len(w)) + 1))
    return frozenset(p for p, n in counts.items() if n >= max(PREFIX_LEAST, PREFIX_SHARE * len(words)))


def read(word: str, prefixes: frozenset[str]) -> list[str]:
    """A word's alphabet and symbols; the alphabet is that of the characters behind its prefix."""
    k = next((k for k in range(min(PREFIX, len(word)), 0, -1) if word[:k] in prefixes), 0)
    bits = 0
    for c in word[k:]:
        bits |= 1 << _NUMBER[symbol(c)]
    return [_ALPHABET[bits], *word[:k], *(c if symbol(c) == "-" else ANY for c in word[k:])]


def prefix_tree(words: list[Sequence[str]]) -> Automaton:
    """Of words as lists of symbols."""
    tree = Automaton()
    for word in words:
        q = 0
        for s in word:
            if s not in tree.go[q]:
                tree.go[q][s] = len(tree.go)
                tree.go.append({}), tree.left.append({}), tree.ended.append(0)
            tree.left[q][s] = tree.left[q].get(s, 0) + 1
            q = tree.go[q][s]
        tree.ended[q] += 1
    return tree


def _differ(a: int, n: int, b: int, m: int, alpha: float) -> bool:
    return n > 0 and m > 0 and abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def compatible(t: Automaton, p: int, q: int, alpha: float) -> bool:
    """Whether two states' futures agree within the Hoeffding bound, as far as both have any."""
    todo, seen = [(p, q)], set()
    while todo:
        p, q = todo.pop()
        if p == q or (p, q) in seen:
            continue
        seen.add((p, q))
        n, m = t.total(p), t.total(q)
        if not n or not m:
            continue
        if _differ(t.ended[p], n, t.ended[q], m, alpha) or any(_differ(t.left[p].get(s, 0), n, t.left[q].get(s, 0), m, alpha) for s in {*t.left[p], *t.left[q]}):
            return False
        todo += [(t.go[p][s], t.go[q][s]) for s in t.go[p] if s in t.go[q]]
    return True


def infer(words: list[Sequence[str]], alpha: float = ALPHA) -> Automaton:
    """Kept states are compared with each frontier state; a compatible one takes it in, with its
    subtree folded in below, else the frontier state is kept too."""
    t = prefix_tree(words)
    kept = [0]
    while True:
        edges = [(p, s) for p in kept for s in sorted(t.go[p]) if t.go[p][s] not in kept]
        if not edges:
            break
        p, s = edges[0]
        q = t.go[p][s]
        into = next((r for r in kept if compatible(t, r, q, alpha)), None)
        if into is None:
            kept.append(q)
            continue
        t.go[p][s] = into
        todo = [(into, q)]
        while todo:
            a, b = todo.pop()
            t.ended[a] += t.ended[b]
            for c, n in t.left[b].items():
                t.left[a][c] = t.left[a].get(c, 0) + n
                if c in t.go[a]:
                    todo.append((t.go[a][c], t.go[b][c]))
                else:
                    t.go[a][c] = t.go[b][c]
    number = {q: i for i, q in enumerate(kept)}
    return Automaton([{s: number[r] for s, r in t.go[q].items()} for q in kept], [t.left[q] for q in kept], [t.ended[q] for q in kept])


@dataclass
class Formats:
    """limits: by how much a kind is rarer than tokens are, as a log."""

    automata: dict[str, Automaton]
    background: Background
    limits: dict[str, float]

    def __post_init__(self) -> None:
        self.logs = self.background.logs()
        best = [a.best() - self.limits[k] for k, a in self.automata.items()]
        self.best = np.max(best, axis=0) if best else np.full(len(ALPHABETS), -np.inf)

    def ground(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log likelihood of each token as an ordinary one."""
        sums = np.concatenate([[0.0], np.cumsum(self.logs[_contexts(code) * _SIZE + np.append(code, 0)])])
        return sums[ends + 1] - sums[starts]

    def score(self, word: str) -> float:
        """How far the likeliest format outweighs an ordinary token; positive: a credential's format."""
        ground = float(self.ground(classes(word), np.array([0]), np.array([len(word)]))[0])
        return max((a.log_likelihood(word) - ground - self.limits[k] for k, a in self.automata.items()), default=-math.inf)

    def likely(self, text: str) -> Iterator[tuple[int, int]]:
        """Start and end of the candidates of a credential's format, in order."""
        code = classes(text)
        starts, ends = tokens(code)
        long_ = ends - starts >= LEAST_FORMAT
        starts, ends = starts[long_], ends[long_]
        if not len(starts):
            return
        bits = np.bitwise_or.reduceat(np.append(np.left_shift(1, code), 1), np.stack([starts, ends], axis=1).ravel())[::2]
        plain = np.concatenate([[0], np.cumsum((code > 0) & (code < SYMBOLS))])
        alphabet = _ALPHABET_NO[bits]
        sizes = np.log(np.array(list(ALPHABETS.values())))
        bound = self.best[alphabet] - (plain[ends] - plain[starts]) * sizes[alphabet] - self.ground(code, starts, ends)
        # The bound is of words without a prefix.
        firsts = [ord(p) for a in self.automata.values() for p in a.prefixes if len(p) == 1]
        if firsts:
            bound[np.isin([ord(text[i]) for i in starts.tolist()], firsts)] = np.inf
        for start, end in zip(starts[bound > 0].tolist(), ends[bound > 0].tolist()):
            if self.score(text[start:end]) > 0:
                yield start, end


def _formats(samples: dict[str, list[str]], numbers: dict[str, int], background: Background) -> Formats:
    automata = {}
    for kind in KINDS:
        if words := sorted(samples.get(kind, [])):
            prefixes = common_prefixes(words)
            automata[kind] = infer([read(w, prefixes) for w in words])
            automata[kind].prefixes = prefixes
    return Formats(automata, background, {k: max(0.0, math.log(max(1, background.tokens) / max(1, numbers[k]))) for k in automata})


def _fit(samples: dict[str, list[str]], words: list[str]) -> Formats:
    """Formats of these credentials against these words."""
    background = Background()
    background.add(" ".join(words))
    return _formats(samples, {k: len(v) for k, v in samples.items()}, background)


def train(docs: DataFrame, *, text_col: str = "text") -> Formats:
    """Automata from the base spans' values (a bounded sample by hash) and counts of all other tokens.

    Null and empty texts say nothing; without credentials there are no automata; other columns are ignored.
    """
    frame = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Credentials, and at the end the counts of the partition's other tokens."""
        ground = Background()
        for whole in batches:
            for batch in by_bytes(whole, 0):
                found, plain = [], []
                for text in batch.column(0).to_pylist():
                    at = 0
                    for kind, start, end in sorted(base_spans(text), key=lambda x: x[1:]):
                        found.append((kind, ASSIGN.match(text[start:end])[1] if kind == "assign" else text[start:end]))
                        plain.append(text[at:start])
                        at = max(at, end)
                    plain.append(text[at:])
                ground.add(" ".join(plain))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([ground.counts.ravel().tolist()], pa.list_(pa.int64())), pa.array([ground.tokens], pa.int64())], names)

    names = ["kind", "value", "counts", "tokens"]
    told = stored(frame.mapInArrow(label, "kind string, value string, counts array<long>, tokens long"))
    numbers = {r["kind"]: r["n"] for r in told.filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    place = F.posexplode("counts").alias("at", "n")
    background = Background(tokens=told.agg(F.sum("tokens").alias("n")).first()["n"] or 0)
    for r in told.filter("counts IS NOT NULL").select(place).groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a place
        background.counts.flat[r["at"]] = r["n"]
    # The first values by hash in each of SLOTS parts of the hashes: no task ranks all of a kind.
    slot = Window.partitionBy("kind", "slot").orderBy("pick", "value")
    values = told.filter((F.char_length("value") <= LONGEST)).select("kind", "value").distinct().withColumn("pick", F.xxhash64("value")).withColumn("slot", F.pmod("pick", F.lit(SLOTS)))
    chosen = values.withColumn("rank", F.row_number().over(slot)).filter(F.col("rank") <= CREDENTIALS_PER_KIND // SLOTS).select("kind", "value").collect()
    samples: dict[str, list[str]] = defaultdict(list)
    for r in chosen:
        samples[r["kind"]].append(r["value"])
    return _formats(samples, numbers, background)


def find_spans(text: str | None, formats: Formats | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the added ones, which overlap no base span."""
    if not text:
        return [], []
    base = base_spans(text)
    added = []
    if formats and formats.automata:
        taken, k, reach = sorted((s, e) for _, s, e in base), 0, 0
        for start, end in formats.likely(text):
            while k < len(taken) and taken[k][0] < end:
                reach, k = max(reach, taken[k][1]), k + 1
            if reach <= start:
                added.append((ADDED, start, end))
    return base, added


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = {k: i for i, k in enumerate((*KINDS, ADDED))}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def scan(docs: DataFrame, formats: Formats | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    A null text counts as empty and has no spans; repeated rows give repeated rows; an empty table
    gives an empty result. Spans of one start follow the order of their kinds. Very long texts are read whole. Other columns are ignored, whatever their names.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                rows = []
                for text in batch.column(1).to_pylist():
                    base, added = find_spans(text, shared.value)
                    kinds = [k for k, _, _ in base]
                    rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
                columns = list(zip(*rows)) or [()] * 6
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(find, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, formats: Formats | None = None, *, text_col: str = "text", placeholder: str = PLACEHOLDER) -> DataFrame:
    """docs with every span's text replaced by the placeholder.

    Null and empty texts, other columns and their order are unchanged; repeated rows give repeated rows; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, added = find_spans(text, shared.value)
        at, out = 0, []
        for _, start, end in sorted(base + added, key=lambda x: (x[1], -x[2])):
            if start >= at:
                out += [text[at:start], placeholder]
            at = max(at, end)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def cleaned(texts):  # noqa: ANN001, ANN202
        return texts.map(clean, na_action="ignore").astype(object)

    return docs.withColumn(text_col, cleaned(F.col(text_col)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans alone, as the scan gives them."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


#: The base spans by their patterns; alternatives of either case are spelt out.
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_FIXED = {
    "assign": rf"""({_WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
_RAW = " UNION ALL ".join(
    f"SELECT doc_id, {no} AS no, '{k}' AS kind, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {2 if k == 'assign' else 0}) AS vs, regexp_split_to_array(text, '{p}') AS gaps FROM d"
    for no, (k, p) in enumerate(_FIXED.items())
)
BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
one AS (SELECT doc_id, no, kind, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[1:len(ms)]) AS gap FROM ({_RAW})),
placed AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, no ORDER BY i) AS BIGINT) AS e FROM one),
kept AS (SELECT *, e - length(m) AS s FROM placed WHERE length(v) >= CASE kind WHEN 'assign' THEN {LEAST_ASSIGN} WHEN 'access' THEN {LEAST_ACCESS} ELSE 24 END),
by_doc AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN by_doc USING (doc_id)
"""
