"""Repair of conversations' structure by the cheapest edits, solved once for each distinct signature.

A conversation's rows, in order, are encoded as a compact string, its signature: one letter a row
for the role's initial (s, u, a, or o for any other; capital if the text is truncated), or x for a row that has
to go. Very many conversations share a signature; each distinct one is solved once by a memoised
recursion over (row, role before it). The audit, one letter an edit, is joined back to the
conversations of that signature and replayed over their rows.

Rows of a conversation are read as a stream, sorted by Spark inside its partition, never as a list:
a task holds one letter a row and the batch at hand. A conversation itself stays in one task, as its
digest, a hash of all its text in order, can't be put together from parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, by_bytes, stored, table

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLED, DELETED, INSERTED, TRUNCATED = 1, 2, 5, 5
#: Letter of a row that has to be deleted.
GOES = "x"
#: Rows that the recursion goes down at once.
STRIDE = 64
#: Inserts in a row; a third would come back to the place after the first.
MOST_INSERTS = 2

#: Places in `(s?(ua)+)?`: at the start, after s, after u, after a. What an initial leads to, where it may stand.
START, SYSTEM, USER, ASSISTANT = range(4)
FITS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
WANTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = {"su", "ua", "au"}

_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits that give `(s?(ua)+)?`; of equally cheap ones the ASCII-least audit.

    An edit's letter tells what follows it, so of equally cheap edits at one place the least letter is taken.
    The recursion runs from the signature's end in strides, so its depth and the costs held are bounded; of
    each place only the letter of its best edit is kept.
    """
    n = len(signature)
    best = bytearray(12 * (n + 1))
    costs: dict[tuple[int, int, int], float] = {}

    def least(i: int, state: int, run: int) -> float:
        known = costs.get((i, state, run))
        if known is not None:
            return known
        options = [(0.0, "")] if i == n and state in (START, ASSISTANT) else []
        if run < MOST_INSERTS:
            options.append((INSERTED + least(i, WANTED[state][1], run + 1), INSERT))
        if i < n:
            options.append((DELETED + least(i + 1, state, 0), DELETE))
            letter = signature[i]
            if letter != GOES:
                initial = letter.lower()
                more = 0 if letter == initial else TRUNCATED
                if (initial, state) in FITS:
                    options.append((more + least(i + 1, FITS[initial, state], 0), KEEP))
                options.append((more + REROLED + least(i + 1, WANTED[state][1], 0), REROLE))
        cost, edit = min(options, default=(float("inf"), ""))
        costs[i, state, run] = cost
        best[12 * i + 3 * state + run] = ord(edit) if edit else 0
        return cost

    for i in [*range(n - n % STRIDE, -1, -STRIDE)]:
        for state in range(4):
            least(i, state, 0)
        for place in [p for p in costs if p[0] > i]:
            del costs[place]
    audit, i, state, run = [], 0, START, 0
    while edit := best[12 * i + 3 * state + run]:
        letter = chr(edit)
        audit.append(letter)
        if letter == INSERT:
            state, run = WANTED[state][1], run + 1
            continue
        if letter == KEEP:
            state = FITS[signature[i].lower(), state]
        elif letter == REROLE:
            state = WANTED[state][1]
        i, run = i + 1, 0
    return int(costs[0, START, 0]), "".join(audit)


def _letter(role: str, goes: bool, cut_short: bool) -> str:
    if goes:
        return GOES
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if cut_short else initial


def damage(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults put in by crc32 of `conversation:turn` modulo 20, and `present`, false for dropped rows.

    0 drops a row, 1 empties its text, 2 takes its stops, 3 repeats it, 4 makes its role user. Nulls in the key,
    the role and the text are one space; a null turn stays null. Other columns are dropped.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", space(conv_col), space(turn_col)).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), fault.alias("fault"))
        .withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"))
    )


def _clean(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), there.alias("present")).withColumn("digest", F.sha2("text", 256))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation of a stream sorted by conversation, presence and turn."""
    conv = None
    out: list[tuple] = []
    now: list | None = None  # of the conversation at hand: id, turns first, last and distinct, counts, last initial, letters

    def told() -> tuple:
        conv_id, first, last, turns, counts, _, letters = now
        return conv_id, last - first + 1 - turns if turns else 0, *counts, "".join(letters)

    def batch() -> pa.RecordBatch:
        kinds = (conv, *[pa.int64()] * 5, pa.string())
        names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names)

    for given in batches:
        conv = given.schema.field("conv_id").type
        for conv_id, turn, role, present, blank, cut_short, repeated in zip(*(c.to_pylist() for c in given.columns)):
            if now is None or conv_id != now[0]:
                if now is not None:
                    out.append(told())
                now = [conv_id, None, None, 0, [0, 0, 0, 0], None, []]
            if not present:
                continue
            if turn is not None and turn != now[2]:
                now[1], now[2], now[3] = turn if now[1] is None else now[1], turn, now[3] + 1
            counts, initial = now[4], role[:1]
            fault = 0 if blank else 1 if repeated else 2 if cut_short else None
            if fault is not None:
                counts[fault] += 1
            counts[3] += now[5] is not None and now[5] + initial not in LEGAL
            now[5] = initial
            now[6].append(_letter(role, blank or repeated, cut_short))
        yield batch()
        out.clear()
    if now is not None:
        out.append(told())
        yield batch()


def _audits(clean: DataFrame) -> DataFrame:
    """conv_id, counts, cost and audit of each conversation; stores its summaries."""
    kind = clean.schema["conv_id"].dataType.simpleString()
    bare = F.btrim("text", F.lit(SPACES))
    narrow = clean.select("conv_id", "turn", "role", "digest", "present", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut_short"))
    # The window and the sort keep to the partitions made here: one shuffle, of narrow rows.
    seen = Window.partitionBy("conv_id", "present", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    ordered = narrow.repartition("conv_id").withColumn("repeated", F.row_number().over(seen) > 1).sortWithinPartitions("conv_id", "present", F.col("turn").asc_nulls_first(), "role", "digest")
    told = stored(
        ordered.select("conv_id", "turn", "role", "present", "blank", "cut_short", "repeated").mapInArrow(
            _summaries, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
        )
    )

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signatures = b.column(0).to_pylist()
            found = [solve(s) for s in signatures]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])

    audits = told.select("signature").distinct().mapInArrow(solved, "signature string, cost long, audit string")
    return told.join(audits, "signature").select("conv_id", *_STATS, "audit")


def audits(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn, nulls first; rows of one turn by role, then by a hash of the text. A null role
    or text is one space; a null conversation is one like any other. gaps counts the turns missing between the
    least and the greatest. Each row's first fault counts: blank (no word), duplicate (role and text seen earlier),
    truncated (no stop at the end); illegal counts neighbours that may not follow each other. Very long texts are
    read by Spark's functions only; very long conversations hold a letter a row. Where present_col is false,
    a row only names its conversation. An empty table gives an empty result; other columns are ignored.
    """
    return _audits(_clean(rows, conv_col, turn_col, role_col, text_col, present_col))


def _replayed(clean: DataFrame) -> DataFrame:
    """For each conversation, one after the other, a row with its counts (place -1), then its repaired rows."""
    audit = _audits(clean)
    head = audit.select("conv_id", F.lit(False).alias("present"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), *_STATS, "audit")
    body = clean.filter("present").select("conv_id", "present", "turn", "role", "digest", "text", *[F.lit(None).cast("long").alias(c) for c in _STATS], F.lit(None).cast("string").alias("audit"))
    # The audit comes first of its conversation's rows.
    stream = head.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "present", F.col("turn").asc_nulls_first(), "role", "digest")
    kind = clean.schema["conv_id"].dataType.simpleString()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place = "", 0, START, 0
        left: list = []  # conv_id of the conversation at hand, whose last inserts are still to come
        out: list[tuple] = []
        none = (None,) * (len(_STATS) + 1)

        def inserts() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == INSERT:
                role, state = WANTED[state]
                out.append((left[0], place, INSERT, role, "", *none))
                at, place = at + 1, place + 1

        def flush(conv: pa.DataType) -> pa.RecordBatch:
            kinds = (conv, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * len(_STATS), pa.string())
            names = ("conv_id", "place", "edit", "role", "text", *_STATS, "audit")
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(names), kinds)], names)
            out.clear()
            return made

        conv = None
        for whole in batches:
            conv = whole.schema.field("conv_id").type
            for given in by_bytes(whole, 4):
                for row in zip(*(c.to_pylist() for c in given.columns)):
                    if not row[1]:
                        if left:
                            inserts()
                        audit, at, state, place, left = row[-1], 0, START, 0, [row[0]]
                        out.append((row[0], -1, None, None, None, *row[5:]))
                        continue
                    inserts()
                    edit, role = audit[at], row[3]
                    at += 1
                    if edit == DELETE:
                        continue
                    if edit == KEEP:
                        state = FITS[role[:1], state]
                    else:
                        role, state = WANTED[state]
                    out.append((row[0], place, edit, role, row[4], *none))
                    place += 1
                yield flush(conv)
        if left:
            inserts()
            yield flush(conv)

    columns = ("conv_id", "present", "turn", "role", "text", *_STATS, "audit")
    return stream.select(*columns).mapInArrow(replay, f"conv_id {kind}, place long, edit string, role string, text string, " + ", ".join(f"{c} long" for c in _STATS) + ", audit string")


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """Repaired rows: conv_id, place (from 0), edit (K kept, R given a role, I inserted), role, text.

    Defined for all input as in `audits`; a conversation without rows left has none here.
    """
    return _replayed(_clean(rows, conv_col, turn_col, role_col, text_col, present_col)).filter("place >= 0").select("conv_id", "place", "edit", "role", "text")


def _digested(replayed: DataFrame) -> DataFrame:
    kind = replayed.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple | None = None
        hashed, conv = hashlib.sha256(), None
        names = ("conv_id", *_STATS, "audit", "repaired_sha256")

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (conv, *[pa.int64()] * len(_STATS), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(names), kinds)], names)

        for given in batches:
            conv, done = given.schema.field("conv_id").type, []
            for row in zip(*(c.to_pylist() for c in given.columns)):
                if row[1] < 0:
                    if head:
                        done.append((*head, hashed.hexdigest()))
                    head, hashed = (row[0], *row[5:]), hashlib.sha256()
                else:
                    hashed.update((f"\n{row[3]}:{row[4]}" if row[1] else f"{row[3]}:{row[4]}").encode())
            yield made(done)
        if head:
            yield made([(*head, hashed.hexdigest())])

    return replayed.mapInArrow(digest, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _STATS) + ", audit string, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(_replayed(_clean(damage(table(spark, sf_dir, "conversations")), "conv_id", "turn", "role", "text", "present")))


#: The same in SQL: crc32 by its table, edits by dynamic programming from each signature's end.
ORACLE_SQL = r"""
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM conversations, crcs
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM (SELECT *, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE fault <> 0)
), ordered AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS no,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS repeated,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut_short
  FROM damaged
), lettered AS (
  SELECT *, CASE WHEN blank OR repeated THEN 'x' WHEN cut_short THEN upper(CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END)
      WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS letter,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY no) || initial AS pair
  FROM ordered
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND repeated) AS duplicate,
    count(*) FILTER (NOT blank AND NOT repeated AND cut_short) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    string_agg(letter, '' ORDER BY no) AS signature
  FROM lettered GROUP BY conv_id
), steps AS (
  SELECT signature, length(signature) AS i, {'c': 0, 'a': ''} AS v0, {'c': 10, 'a': 'II'} AS v1, {'c': 5, 'a': 'I'} AS v2, {'c': 0, 'a': ''} AS v3
  FROM (SELECT DISTINCT signature FROM told)
  UNION ALL
  SELECT signature, i - 1,
    list_min([b0, {'c': b2.c + 5, 'a': 'I' || b2.a}, {'c': b3.c + 10, 'a': 'II' || b3.a}]), list_min([b1, {'c': b2.c + 5, 'a': 'I' || b2.a}, {'c': b3.c + 10, 'a': 'II' || b3.a}]),
    list_min([b2, {'c': b3.c + 5, 'a': 'I' || b3.a}]), list_min([b3, {'c': b2.c + 5, 'a': 'I' || b2.a}])
  FROM (
    SELECT signature, i,
      list_min([{'c': v0.c + 2, 'a': 'D' || v0.a}, {'c': CASE WHEN r = 's' THEN v1.c WHEN r = 'u' THEN v2.c ELSE 1000000 END + more, 'a': 'K' || CASE WHEN r = 's' THEN v1.a ELSE v2.a END}, {'c': v2.c + 1 + more, 'a': 'R' || v2.a}]) AS b0,
      list_min([{'c': v1.c + 2, 'a': 'D' || v1.a}, {'c': CASE WHEN r = 'u' THEN v2.c ELSE 1000000 END + more, 'a': 'K' || v2.a}, {'c': v2.c + 1 + more, 'a': 'R' || v2.a}]) AS b1,
      list_min([{'c': v2.c + 2, 'a': 'D' || v2.a}, {'c': CASE WHEN r = 'a' THEN v3.c ELSE 1000000 END + more, 'a': 'K' || v3.a}, {'c': v3.c + 1 + more, 'a': 'R' || v3.a}]) AS b2,
      list_min([{'c': v3.c + 2, 'a': 'D' || v3.a}, {'c': CASE WHEN r = 'u' THEN v2.c ELSE 1000000 END + more, 'a': 'K' || v2.a}, {'c': v2.c + 1 + more, 'a': 'R' || v2.a}]) AS b3
    FROM (SELECT *, lower(signature[i]) AS r, CASE WHEN signature[i] = 'x' THEN 1000000 WHEN signature[i] = lower(signature[i]) THEN 0 ELSE 5 END AS more FROM steps WHERE i > 0)
  )
), audited AS (
  SELECT t.*, s.v0.c AS cost, s.v0.a AS audit FROM told t JOIN steps s ON s.signature = t.signature AND s.i = 0
), edits AS (
  SELECT conv_id, edit, p, sum((edit <> 'I')::INT) OVER w AS no, sum((edit <> 'D')::INT) OVER w AS place
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS p FROM audited WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), placed AS (
  SELECT e.conv_id, e.p, e.edit, e.place, r.role, r.text, max((e.place = 1 AND e.edit = 'K' AND r.initial = 's')::INT) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN ordered r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.no = e.no AND e.edit <> 'I'
  WHERE e.edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS whole
  FROM placed GROUP BY conv_id
)
SELECT c.conv_id, coalesce(a.gaps, 0)::BIGINT AS gaps, coalesce(a.blank, 0)::BIGINT AS blank, coalesce(a.duplicate, 0)::BIGINT AS duplicate, coalesce(a.truncated, 0)::BIGINT AS truncated,
  coalesce(a.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN audited a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
