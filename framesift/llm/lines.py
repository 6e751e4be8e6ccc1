"""Removal of lines that documents share, by arrays behind sharded minimal perfect hashes.

A line's key is hashed to 128 bits. The distinct hashes found in two documents or more are dealt to
shards; a shard's minimal perfect hash gives each of its n hashes a place from 0 to n - 1 of three
compact arrays: a fingerprint (a place is given to any hash; the fingerprint tells the shard's own), the number of
lines, and the least document. Documents probe these arrays with their own lines' hashes; lines are
never joined to lines.

Hashes that very many lines have are few, at most HOT_KEYS of them: they make a shard of their own, which is
broadcast and probed where the documents are read. All other probes are dealt to the shards, where no
hash has more than one in HOT_KEYS of all lines. What documents lose comes back as line numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, by_bytes, stored, table

MIN_CHARS = 10
#: Most hashes of the shard that is broadcast, each of 28 bytes and a few bits.
HOT_KEYS = 1 << 14
#: Hashes of a shard on average, and fewest shards.
SHARD_KEYS, FEWEST_SHARDS = 1 << 18, 1 << 10
#: Bits of a level for each hash that it is to place.
ROOM = 1.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _level(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit of each hash in a level."""
    x = h1 ^ (h2 * np.uint64(2 * level + 1))
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return ((x ^ (x >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)


@dataclass
class PerfectHash:
    """Levels of bits: a hash's place is the rank, over all levels, of the first bit it finds set."""

    levels: list[np.ndarray]

    def __post_init__(self) -> None:
        self.ranks, base = [], 0
        for bits in self.levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - 1)
            base += int(bits.sum())

    @classmethod
    def over(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """Of distinct pairs (h1, h2). In each level, hashes alone at their bit set it; the rest go a level down."""
        levels: list[np.ndarray] = []
        while len(h1):
            bits = -(-max(8, int(ROOM * len(h1))) // 8) * 8
            at = _level(h1, h2, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(levels)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of each pair; any place, or -1, for pairs that the hash wasn't made over."""
        found = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for no, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = _level(h1[left], h2[left], no, len(bits))
            here = bits[at]
            found[left[here]] = ranks[at[here]]
            left = left[~here]
        return found

    def packed(self) -> list[bytes]:
        return [np.packbits(bits).tobytes() for bits in self.levels]

    @classmethod
    def unpacked(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in levels])


@dataclass
class Shard:
    """The arrays behind a perfect hash: fingerprint, number of lines, least document."""

    places: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    owners: np.ndarray

    @classmethod
    def over(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> Shard:
        places = PerfectHash.over(h1, h2)
        order = np.argsort(places.places(h1, h2))
        return cls(places, h2[order], counts[order], owners[order])

    def owner(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is one of the shard's, and the least document that holds it."""
        at = self.places.places(h1, h2)
        known = at >= 0
        if len(self.owners):
            known &= self.fingerprints[at] == h2
            return known, np.where(known, self.owners[at], 0)
        return known, at

    def row(self) -> tuple[list[bytes], bytes, bytes, bytes]:
        return self.places.packed(), self.fingerprints.tobytes(), self.counts.tobytes(), self.owners.tobytes()

    @classmethod
    def of_row(cls, levels: list[bytes], fingerprints: bytes, counts: bytes, owners: bytes) -> Shard:
        read = lambda x, kind: np.frombuffer(x, kind)
        return cls(PerfectHash.unpacked(levels), read(fingerprints, np.uint64), read(counts, np.int64), read(owners, np.int64))


_ARRAYS = "levels array<binary>, fingerprints binary, counts binary, owners binary"


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, of (a hash of the text), no and hashes of each line whose key is long enough."""
    key = F.translate(F.btrim("line", F.lit(SPACES)), _UPPER, _LOWER)
    split = docs.select("doc_id", "of", F.posexplode(F.split("text", "\n")).alias("no", "line")).select("doc_id", "of", "no", key.alias("key"))
    # Of the key, and of the key moved by a byte: no hash of 64 bits has to tell keys apart alone.
    return split.filter(F.char_length("key") >= min_chars).select("doc_id", "of", "no", F.xxhash64("key").alias("h1"), F.xxhash64(F.concat(F.lit("\n"), F.col("key"))).alias("h2"))


def repeated(lines: DataFrame) -> DataFrame:
    """h1, h2, lines, owner of each hash found in two documents or more; rows without an id are one document, the last.

    Grouping is of counts, minima and maxima, so a line that very many documents hold is summed before it is dealt.
    """
    least, with_id = F.min("doc_id"), F.count("doc_id")
    told = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("lines"), least.alias("owner"), F.max("doc_id").alias("greatest"), with_id.alias("with_id"))
    return told.filter("owner < greatest OR (owner IS NOT NULL AND with_id < lines)").select("h1", "h2", "lines", "owner")


def index(keys: DataFrame, shards: int) -> DataFrame:
    """shard and its arrays, of hashes dealt to so many shards."""

    def build(group: pa.Table) -> pa.Table:
        column = lambda name: group.column(name).combine_chunks()
        made = Shard.over(_u64(column("h1")), _u64(column("h2")), column("lines").to_numpy(), column("owner").to_numpy())
        values = [group.column("shard")[:1].combine_chunks(), *(pa.array([x], k) for x, k in zip(made.row(), (pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary())))]
        return pa.table(values, ["shard", "levels", "fingerprints", "counts", "owners"])

    dealt = keys.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "lines", "owner")
    return dealt.groupBy("shard").applyInArrow(build, f"shard int, {_ARRAYS}")


def _probed(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, of, no of every line to drop."""
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("lines"), F.lit(0))).first()
    hot_from = total // HOT_KEYS + 1
    shards = max(FEWEST_SHARDS, -(-n // SHARD_KEYS))
    hot = keys.filter(F.col("lines") >= hot_from).toPandas()  # HOT_KEYS rows at most, as their lines add up to at most all
    arrays = lines.sparkSession.sparkContext.broadcast(
        Shard.over(hot["h1"].to_numpy().view(np.uint64), hot["h2"].to_numpy().view(np.uint64), hot["lines"].to_numpy(), hot["owner"].to_numpy()).row()
    )

    def probe_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines settled by the broadcast shard are dropped, marked so, or left out; the others go on to theirs."""
        shard = Shard.of_row(*arrays.value)
        for b in batches:
            known, owner = shard.owner(_u64(b.column(3)), _u64(b.column(4)))
            ids = b.column(0)
            other = ids.is_null().to_numpy(zero_copy_only=False) | (ids.fill_null(0).to_numpy(zero_copy_only=False) != owner)
            on = ~known | other
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(known)], ["doc_id", "of", "no", "h1", "h2", "settled"]).filter(pa.array(on))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's arrays come before its probes."""
        now, shard = None, None
        for b in batches:
            shards_ = b.column(0).to_numpy()
            for start, end in _runs(shards_):
                part = b.slice(start, end - start)
                if now != shards_[start]:
                    now, shard = shards_[start], None
                if part.column(1)[0].as_py() == 0:
                    row = part.slice(0, 1).to_pylist()[0]
                    shard = Shard.of_row(row["levels"], row["fingerprints"], row["counts"], row["owners"])
                    part = part.slice(1)
                goes = part.column(7).to_numpy(zero_copy_only=False).astype(bool)
                if shard is not None and len(part):
                    known, owner = shard.owner(_u64(part.column(5)), _u64(part.column(6)))
                    ids = part.column(2)
                    other = ids.is_null().to_numpy(zero_copy_only=False) | (ids.fill_null(0).to_numpy(zero_copy_only=False) != owner)
                    goes = goes | (known & other)
                yield part.select(["doc_id", "of", "no"]).filter(pa.array(goes, pa.bool_()))

    asked = lines.mapInArrow(probe_hot, "doc_id long, of long, no int, h1 long, h2 long, settled boolean")
    # Settled lines need no shard: they are dealt by their text.
    to = F.pmod(F.when(F.col("settled"), F.hash("of", "no").cast("long")).otherwise(F.col("h1")), F.lit(shards)).cast("int")
    probes = asked.select(to.alias("shard"), F.lit(1).alias("kind"), "doc_id", "of", "no", "h1", "h2", "settled")
    built = index(keys.filter(F.col("lines") < hot_from), shards).withColumn("kind", F.lit(0))
    both = built.unionByName(probes, allowMissingColumns=True)
    names = ("shard", "kind", "doc_id", "of", "no", "h1", "h2", "settled", "levels", "fingerprints", "counts", "owners")
    return both.repartition("shard").sortWithinPartitions("shard", "kind").select(*names).mapInArrow(probe, "doc_id long, of long, no int")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]) if len(values) else iter(())


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_lines (before), n_dropped, text (what is kept).

    A line's key is the line without spaces and controls at its ends, A-Z in lower case. Lines whose key has
    min_chars code points or more and is found in two documents stay in the document of least id only, there
    each time. Null and empty texts are one empty line. Ids are integers; rows that repeat an id are one
    document; rows without one are together one document, after all others. Very long texts are read whole:
    their lines are rows of their own in the search, and a text is a task's only one while it is put together.
    An empty table gives an empty result; other columns are ignored.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("of", F.xxhash64("text"))
    lines = stored(_lines(whole, min_chars))
    keys = stored(repeated(lines))
    drops = _probed(lines, keys).select("doc_id", "of", F.lit(0).alias("kind"), "no", F.lit(None).cast("string").alias("text"))
    texts = whole.select("doc_id", "of", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("no"), "text")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers of lines to drop come before the texts of their id and hash."""
        now, gone = None, set()
        for whole_batch in batches:
            for b in by_bytes(whole_batch, 4):
                out = []
                for doc_id, of, kind, no, text in zip(*(c.to_pylist() for c in b.columns)):
                    if (doc_id, of) != now:
                        now, gone = (doc_id, of), set()
                    if kind == 0:
                        gone.add(no)
                        continue
                    given = text.split("\n")
                    kept = [x for i, x in enumerate(given) if i not in gone] if gone else given
                    out.append((doc_id, len(given), len(given) - len(kept), "\n".join(kept)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_lines", "n_dropped", "text"])

    stream = drops.union(texts).repartition("doc_id", "of").sortWithinPartitions("doc_id", "of", "kind")
    return stream.mapInArrow(put_together, "doc_id long, n_lines long, n_dropped long, text string")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, no, list[no] AS line, translate(trim(list[no], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, list, unnest(range(1, len(list) + 1)) AS no
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents))
), shared AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drops) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT drops), '')) AS kept_sha256
FROM (SELECT l.*, coalesce(l.doc_id <> s.owner, FALSE) AS drops FROM lines l LEFT JOIN shared s USING (key))
GROUP BY rid, doc_id
"""
