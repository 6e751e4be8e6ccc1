"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

DataFrame functions only. A pattern's matches are set off by a mark and the text is split at the
mark, so that every second piece is a match and the lengths before it give its place in code points.
The mark is a private-use character; where a text holds it already, it first becomes another
character of one code point, which no pattern takes, so places stay right.

The patterns say the same as the fixed ones but cannot backtrack: their repeats are possessive (no
shorter repeat could match either), and a match that could start inside a run of its first class
could start at the run's begin, so only that (or the place where the last match ended) is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kinds of the fixed patterns in order; `iban` is added by this method.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban",)
MARK, INSTEAD = "", ""
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?:[0-9](?![0-9])[ -][0-9]++|[0-9][0-9]++)(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
#: Words near a span that speak for its kind, within NEAR code points before it.
CONTEXT = {
    "email": "mail|contact|write|reply",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|master|credit|payment",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
}
NEAR = 40
#: Lengths that are summed up together where places are told.
RUN = 64
#: Score of a span by its checks alone, and what context adds.
PLAIN = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9}
BONUS = 0.2
_SPANS = "array<struct<kind:string,start:long,end:long,match:string,before:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's rearranged number leaves 1 when divided by 97; letters count from 10."""
    turned = F.split(F.concat(F.substring(iban, 5, 1000), F.substring(iban, 1, 4)), "")
    step = lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)) % 97
    return F.aggregate(turned, F.lit(0), step) == 1


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with value made once for the row and not again wherever `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column, first: Column, n: Column) -> Column:
    """Sum of n values from place `first` (from 0) on."""
    return F.aggregate(F.slice(values, first + 1, n), F.lit(0).cast("long"), lambda a, x: a + x)


def _starts(lengths: Column, use) -> Column:  # noqa: ANN001
    """use(at), where at(i) is the sum of the first i lengths: of whole spans of RUN * RUN lengths, then of
    whole spans of RUN, then of the rest, so that no array grows and each place costs a bounded sum."""

    def sums(values: Column) -> Column:
        spans = F.sequence(F.lit(0), F.call_function("div", F.size(values), F.lit(RUN)).cast("int"))
        return F.transform(spans, lambda b: _sum(values, b * RUN, F.lit(RUN)))

    def at(low: Column, mid: Column, high: Column):  # noqa: ANN202
        part = lambda i, of: F.call_function("div", i, F.lit(of)).cast("int")
        return lambda i: (
            _sum(high, F.lit(0), part(i, RUN * RUN)) + _sum(mid, part(i, RUN * RUN) * RUN, part(i, RUN) - part(i, RUN * RUN) * RUN) + _sum(low, part(i, RUN) * RUN, i - part(i, RUN) * RUN)
        )

    return _bound(lengths, lambda low: _bound(sums(low), lambda mid: _bound(sums(mid), lambda high: use(at(low, mid, high)))))


def _found(kind: str, text: Column, pattern: str, valid) -> Column:  # noqa: ANN001
    """Spans of a pattern's matches that pass `valid`, in order; null-safe, empty without a match."""

    def spans(pieces: Column) -> Column:
        def span(at):  # noqa: ANN001, ANN202
            def one(no: Column) -> Column:
                match, start = F.get(pieces, no), at(no)
                before = F.lower(F.right(F.get(pieces, no - 1), F.lit(NEAR)))
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(match)).alias("end"), match.alias("match"), before.alias("before"))

            return one

        matches = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda no: (no % 2 == 1) & valid(F.get(pieces, no)))
        return _starts(F.transform(pieces, lambda p: F.char_length(p).cast("long")), lambda at: F.transform(matches, span(at)))

    found = _bound(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK), spans)
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"CAST(array() AS {_SPANS})"))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, scored.

    Very long texts are read whole; spans of one start are told apart by their kinds' order.
    scored: the spans with their scores, 0 to 1. A null text counts as empty and has no spans; repeated rows
    give repeated rows; an empty table gives an empty result. Other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, INSTEAD).alias("text"))
    text = F.col("text")
    within = lambda low, high: lambda m: F.length(_digits(m)).between(low, high)
    parts = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
    found = given.select(
        "doc_id",
        F.array(
            _found("email", text, EMAIL, lambda m: F.lit(True)),
            _found("ip", text, IP, lambda m: m.rlike(parts)),
            _found("card", text, CARD, lambda m: within(16, 19)(m) & luhn(_digits(m))),
            _found("phone", text, PHONE, within(8, 15)),
            _found("iban", text, IBAN, mod97),
        ).alias("found"),
    )
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    plain = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(PLAIN[k]) + F.when(s["before"].rlike(CONTEXT[k]), F.lit(BONUS)).otherwise(0.0)) for k in (*KINDS, *ADDED)])
    near = lambda s: F.least(F.lit(1.0), plain(s))
    return found.select(
        "doc_id",
        *[F.size(F.col("found")[i]).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written(F.flatten(F.slice("found", 1, len(KINDS)))).cast("binary"), 256).alias("base_sha256"),
        written(F.flatten("found")).alias("spans"),
        F.size(F.col("found")[len(KINDS)]).cast("long").alias("n_iban"),
        F.transform(F.flatten("found"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(near(s), 2).alias("score"))).alias("scored"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored as text: kind:start:end:score of each span, joined like spans."""
    told = F.transform("scored", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"], s["score"]))
    return personal_data(table(spark, sf_dir, "documents")).withColumn("scored", F.array_join(told, ","))


#: The same by the fixed patterns, their matches laid end to end with the gaps between them.
_FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Za-z0-9]+",
}
_RAW = " UNION ALL ".join(
    f"SELECT doc_id, {no} AS no, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_split_to_array(text, '{p}')[1:len(regexp_extract_all(text, '{p}'))]) AS gap FROM d"
    for no, (k, p) in enumerate(_FIXED.items())
)
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT *, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, no, kind, list(m) AS ms, list(gap) AS gaps FROM ({_RAW}) GROUP BY ALL)),
one AS (SELECT doc_id, no, kind, i, ms[i] AS m, gaps[i] AS gap FROM raw),
placed AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, no ORDER BY i) AS BIGINT) AS e FROM one),
found AS (SELECT *, e - length(m) AS s, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM placed WHERE no < 4 OR regexp_full_match(m, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}')),
told AS (SELECT found.*, lower(right(CASE WHEN no < 4 THEN gap ELSE substr(text, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)) END, {NEAR})) AS before,
    substr(m, 5) || left(m, 4) AS turned FROM found JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id, no ORDER BY i)),
valid AS (SELECT *, CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR TRY_CAST(x AS INT) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum([CASE WHEN k % 2 = 0 THEN CAST(digits[length(digits) - k] AS INT) ELSE CAST(digits[length(digits) - k] AS INT) * 2 - CASE WHEN digits[length(digits) - k] > '4' THEN 9 ELSE 0 END END for k in range(length(digits))]) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    ELSE list_reduce([CASE WHEN turned[k] BETWEEN '0' AND '9' THEN CAST(turned[k] AS INT) ELSE 100 + ascii(turned[k]) - 55 END for k in range(1, length(turned) + 1)], lambda a, x: CASE WHEN x < 100 THEN (a * 10 + x) % 97 ELSE (a * 100 + x - 100) % 97 END, 0) = 1 END AS ok,
    CASE kind {" ".join(f"WHEN '{k}' THEN CASE WHEN regexp_matches(before, '{CONTEXT[k]}') THEN '{min(1.0, round(PLAIN[k] + BONUS, 2))}' ELSE '{PLAIN[k]}' END" for k in (*KINDS, *ADDED))} END AS score FROM told),
kept AS (SELECT *, kind || ':' || s || ':' || e AS span FROM valid WHERE ok),
by_doc AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in (*KINDS, *ADDED))}, string_agg(span, ',' ORDER BY no, i) FILTER (no < 4) AS base,
    string_agg(span, ',' ORDER BY no, i) AS spans, string_agg(span || ':' || score, ',' ORDER BY no, i) AS scored FROM kept GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*KINDS, *ADDED))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scored, '') AS scored
FROM d LEFT JOIN by_doc USING (doc_id)
"""
