"""Quality rules: a learned decision list over text statistics, as ordered Spark conditions.

DataFrame functions only. Statistics of every text are made once and cut to the shared folder. From
those of labelled texts, sequential covering learns rules for bad texts: a conjunction grows by the
threshold of greatest information gain on the grow part, is pruned to the prefix of greatest worth
on the prune part, joins the list while it is right more often than not there, and takes the rows it
covers away. Each step is one Spark aggregation of counts by statistic, bin and label; the driver
sees only those counts (statistics x BINS x 2). Thresholds are quantiles over all labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, crc_fold, cut, table

SYMBOLS = "#*$%&|<>"
WINDOW = 3
LEAST_WORDS, MOST_REPEATED = 50, 50
STATISTICS = ("symbol_rate", "shout_rate", "upper_rate", "digit_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "mean_word", "n_words")
BINS = 32
MOST_RULES, MOST_CONDITIONS, LEAST_COVERED = 12, 4, 4


@dataclass(frozen=True)
class Condition:
    """statistic > threshold if above, else statistic <= threshold; cut_no counts the thresholds."""

    statistic: str
    above: bool
    cut_no: int
    threshold: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.threshold if self.above else c <= self.threshold


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rates learned from.

    A null text has no words: all counts and rates are 0.
    """
    text = F.col("text")
    less = lambda chars: (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = given.select(
        "doc_id",
        less(SPACES).alias("_spaces"), F.char_length("text").cast("long").alias("_chars"), less(SYMBOLS).alias("n_symbols"), less("!").alias("_shouts"),
        less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"), less("0123456789").alias("_digits"),
        lines.alias("_lines"), F.split(F.btrim(text, F.lit(SPACES)), SPACE_RUN).alias("_words"),
    )
    n = F.when(F.element_at("_words", 1) == "", 0).otherwise(F.size("_words")).cast("long")
    words = split.select("*", n.alias("n_words"))
    at = lambda i: F.col("_words")[i]
    none = F.expr("CAST(array() AS array<bigint>)")
    hashes = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    windows = words.select("*", F.when(F.col("n_words") >= WINDOW, hashes).otherwise(none).alias("_windows"))
    # Only texts with a repeated window pay for sorting their windows by hash and place.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = windows.select("*", F.when(repeats, placed).otherwise(F.expr("CAST(array() AS array<struct<h:bigint,i:int>>)")).alias("_placed"))
    there = lambda j: F.get("_placed", j)["h"]
    twice = F.filter("_placed", lambda s, j: F.coalesce(s["h"] == there(j - 1), F.lit(False)) | F.coalesce(s["h"] == there(j + 1), F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda s: s["i"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    chars = F.col("_chars") - F.col("_spaces")
    rate = lambda c, of: F.when(of > 0, c / of).otherwise(0.0)
    counted = sorted_.select(
        "doc_id", "n_words", chars.alias("word_chars"), "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"), "_shouts", "_upper", "_digits", F.when(F.col("n_words") > 0, F.size(F.array_distinct("_words"))).otherwise(0).alias("_distinct"),
    )
    c = F.col
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rate(c("n_symbols"), c("n_words")).alias("symbol_rate"), rate(c("_shouts"), c("n_words")).alias("shout_rate"), rate(c("_upper"), c("word_chars")).alias("upper_rate"),
        rate(c("_digits"), c("word_chars")).alias("digit_rate"), rate(c("n_dup_lines"), c("_n_lines")).alias("dup_line_rate"), rate(c("n_repeat_words"), c("n_words")).alias("repeat_rate"),
        rate(c("_distinct"), c("n_words")).alias("distinct_rate"), rate(c("word_chars"), c("n_words")).alias("mean_word"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def learn(labelled: DataFrame, *, good_col: str = "good", key_col: str = "doc_id") -> list[list[Condition]]:
    """Ordered rules for bad rows; labelled has STATISTICS, a boolean good_col and a key to split by."""
    quantiles = labelled.agg(*[F.percentile_approx(F.col(s).cast("double"), [i / BINS for i in range(1, BINS)], 10000).alias(s) for s in STATISTICS]).first()
    if quantiles[STATISTICS[0]] is None:
        return []
    cuts = {s: sorted(set(quantiles[s])) for s in STATISTICS}
    place = lambda s: F.size(F.filter(F.array(*[F.lit(x) for x in cuts[s]]), lambda x: x < F.col(s)))
    bins = [place(s).alias(s) for s in STATISTICS]
    rows = cut(labelled.select(F.col(good_col).alias("_good"), (F.pmod(F.xxhash64(key_col), F.lit(3)) == 0).alias("_prunes"), *bins))

    def on_bins(c: Condition) -> Column:
        return F.col(c.statistic) > c.cut_no if c.above else F.col(c.statistic) <= c.cut_no

    def counts(where: Column) -> dict[tuple[str, int], tuple[int, int]]:
        """Bad and good rows by statistic and bin."""
        pairs = F.inline(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("bin")) for s in STATISTICS]))
        got = rows.filter(where).select("_good", pairs).groupBy("s", "bin").agg(F.count_if(~F.col("_good")).alias("p"), F.count_if("_good").alias("n")).collect()
        return {(r["s"], r["bin"]): (r["p"], r["n"]) for r in got}

    def best(where: Column) -> tuple[Condition, int, int] | None:
        table_ = counts(where)
        p0 = sum(v[0] for (s, _), v in table_.items() if s == STATISTICS[0])
        n0 = sum(v[1] for (s, _), v in table_.items() if s == STATISTICS[0])
        found = None
        for s in STATISTICS:
            low_p = low_n = 0
            for k, threshold in enumerate(cuts[s]):
                p, n = table_.get((s, k), (0, 0))
                low_p, low_n = low_p + p, low_n + n
                for above, cp, cn in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                    if cp >= LEAST_COVERED and cp + cn < p0 + n0:
                        gain = cp * (math.log2(cp / (cp + cn)) - math.log2(p0 / (p0 + n0)))
                        if gain > 1e-9 and (found is None or gain > found[0]):
                            found = (gain, Condition(s, above, k, float(threshold)), cp, cn)
        return found and found[1:]

    rules: list[list[Condition]] = []
    free = F.lit(True)
    while len(rules) < MOST_RULES:
        rule: list[Condition] = []
        while len(rule) < MOST_CONDITIONS:
            grown = best(free & ~F.col("_prunes") & _all([on_bins(c) for c in rule]))
            if not grown:
                break
            rule.append(grown[0])
            if not grown[2]:
                break
        if not rule:
            break
        prefixes = [_all([on_bins(c) for c in rule[: k + 1]]) for k in range(len(rule))]
        held = rows.filter(free & F.col("_prunes")).agg(*[f for k, w in enumerate(prefixes) for f in (F.count_if(w & ~F.col("_good")).alias(f"p{k}"), F.count_if(w & F.col("_good")).alias(f"n{k}"))]).first()
        worth = [(held[f"p{k}"] - held[f"n{k}"]) / max(1, held[f"p{k}"] + held[f"n{k}"]) for k in range(len(rule))]
        keep = max(range(len(rule)), key=lambda k: (worth[k], -k))
        if worth[keep] <= 0 or held[f"p{keep}"] < LEAST_COVERED // 2:
            break
        rules.append(rule[: keep + 1])
        free = free & ~prefixes[keep]
    return _widest(labelled, rules)


def _widest(labelled: DataFrame, rules: list[list[Condition]]) -> list[list[Condition]]:
    """Each threshold moved halfway between the labelled values on its two sides: no row changes sides."""
    every = [c for rule in rules for c in rule]
    if not every:
        return rules
    value = lambda c: F.col(c.statistic).cast("double")
    sides = labelled.agg(*[f for i, c in enumerate(every) for f in (F.max(F.when(value(c) <= c.threshold, value(c))).alias(f"a{i}"), F.min(F.when(value(c) > c.threshold, value(c))).alias(f"b{i}"))]).first()
    moved = {i: c if sides[f"a{i}"] is None or sides[f"b{i}"] is None else replace(c, threshold=(sides[f"a{i}"] + sides[f"b{i}"]) / 2) for i, c in enumerate(every)}
    numbers = iter(range(len(every)))
    return [[moved[next(numbers)] for _ in rule] for rule in rules]


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule fires: the list as one ordered Spark conditional."""
    out = None
    for rule in rules:
        fires = _all([c.column() for c in rule])
        out = F.when(fires, False) if out is None else out.when(fires, False)
    return F.lit(True) if out is None else out.otherwise(True)


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, kept.

    The list is learned from labelled rows that pass the base (labels with null are left out; the
    rows whose crc32 of the id modulo 4 is 2 are held out for measuring). Without labels only the
    base decides. Null and empty texts have no words and fail the base; repeated rows give repeated rows, and
    repeated labels count each; an empty table gives an empty result. Other columns are ignored. A list has up
    to MOST_RULES rules of up to MOST_CONDITIONS thresholds, drawn from BINS quantiles of each statistic. Of
    conditions that gain equally the first by statistic, then threshold, is taken. Very long texts are counted whole.
    """
    stats = cut(text_statistics(docs, id_col=id_col, text_col=text_col))
    marks = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) == 1).alias("good")).filter("good IS NOT NULL").filter(crc_fold(F.col("doc_id"), 4) != 2)
    rules = learn(stats.filter(~base_failed()).join(marks, "doc_id"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rule alone."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return text_statistics(table(spark, sf_dir, "documents")).select("doc_id", *counts, base_failed().alias("base_failed"))


#: The same from words, lines and windows as rows.
BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW - 2})) AS i, unnest([words[k:k + {WINDOW - 1}] FOR k IN range(1, len(words) - {WINDOW - 2})]) AS g FROM w WHERE len(words) >= {WINDOW}),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i + k FOR k IN range({WINDOW})]) AS place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN words]), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c
"""
