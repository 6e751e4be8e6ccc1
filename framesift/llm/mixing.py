"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents are dealt to shards by a seeded hash and laid end to end inside a shard in
seeded order; the layout is cut into blocks of `block_words` words. Sainte-Lague's highest quotients
turn the sources' targets into whole numbers of blocks, each source's blocks into quotas of groups of
GROUP_SHARDS shards, and a group's into one per shard. A shard's quota is met by whole passes over its blocks plus a seeded, evenly spread choice of
the rest; how many of the first i blocks are chosen is a closed formula, so no block is ever a row.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small, table, word_count

SEED = 20
BLOCK_WORDS = 16
SHARD_WORDS = 1_000_000
#: Shards whose quotas one task shares out.
GROUP_SHARDS = 1024
#: Repeated over the sources in order.
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3


def fill_targets(sizes: Sequence[int], weights: Sequence[int], total: int, passes: int = MOST_PASSES) -> list[float]:
    """Shares of total by weight, none above passes x its size; the excess goes to the others by weight."""
    targets: dict[int, float] = {}
    left, active = Fraction(total), list(range(len(sizes)))
    while active:
        weight = sum(weights[i] for i in active)
        full = [i for i in active if left * weights[i] > weight * passes * sizes[i]]
        if not full:
            return [targets.get(i, float(left * weights[i] / weight)) for i in range(len(sizes))]
        for i in full:
            targets[i] = float(passes * sizes[i])
        left -= sum(passes * sizes[i] for i in full)
        active = [i for i in active if i not in targets]
    return [targets[i] for i in range(len(sizes))]


def sainte_lague(claims: Sequence[float], limits: Sequence[int], seats: int) -> list[int]:
    """Seats by the highest quotients claim / (2 k + 1), at most limits[i] each; ties to the earlier claim.

    The seats that every divisor method gives for a divisor somewhat too large are handed out at once;
    at most one more for each claim goes through the heap (more only where limits bind).
    """
    total, n = sum(claims), len(claims)
    given = [0] * n
    if total <= 0:
        return given
    if seats > n:
        divisor = total / (seats - n / 2)
        given = [min(limits[i], max(0, int(claims[i] / divisor + 0.5) - 1)) for i in range(n)]
    left = seats - sum(given)
    heap = [(-claims[i] / (2 * given[i] + 1), i) for i in range(n) if given[i] < limits[i] and claims[i] > 0]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heap[0]
        given[i] += 1
        left -= 1
        if given[i] < limits[i]:
            heapq.heapreplace(heap, (-claims[i] / (2 * given[i] + 1), i))
        else:
            heapq.heappop(heap)
    return given


def _offset(seed: int, source_no: int, shard: int, blocks: int) -> int:
    return int(hashlib.md5(f"{seed}:{source_no}:{shard}".encode()).hexdigest()[:7], 16) % blocks


def _chosen_before(x: Column, block_words: int) -> Column:
    """Words of chosen blocks among the first x words of a shard's layout."""
    i = F.call_function("div", x, F.lit(block_words))
    before = lambda j: F.call_function("div", j * F.col("rest") + F.col("start"), F.col("blocks"))
    return before(i) * block_words + (before(i + 1) - before(i)) * (x % block_words)


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = Fraction(1),
    seed: int = SEED,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    group_shards: int = GROUP_SHARDS,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    Very long texts count whole; of equal quotients that of the earlier source, or shard, goes first.
    Null text has size 0 and is never taken; a null source is a source of its own, ordered last;
    rows that repeat an id are dealt by their sizes too, so that they don't share one shard, and those that
    repeat both are laid out one after the other; an empty table gives an empty result. Other
    columns of the input are ignored, whatever their names. The driver holds one row per source.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = cut(sized.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["source_size"] for r in totals]
    mixed = int(share * sum(sizes))
    wanted = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], mixed)
    shards = [max(1, -(-n // shard_words)) for n in sizes]
    seats = (mixed + block_words // 2) // block_words
    blocks = [MOST_PASSES * -(-n // block_words) for n in sizes]
    quotas = sainte_lague(wanted, blocks, seats)
    plan = spark.createDataFrame(
        [(r["source"], i, sizes[i], wanted[i], shards[i], quotas[i]) for i, r in enumerate(totals)],
        "source string, source_no int, source_size long, target double, shards int, quota long",
    )
    plan = small(plan, len(totals))
    dealt = sized.join(plan, sized.source.eqNullSafe(plan.source)).select(
        "doc_id", "size", "key", "source_no", "source_size", "target", "quota",
        (F.conv(F.substring("key", 1, 7), 16, 10).cast("long") % F.col("shards")).cast("int").alias("shard"),
    )

    def apportion(parts: pd.DataFrame) -> list[int]:
        """Blocks of one quota for parts in order, by their words, up to MOST_PASSES times their blocks."""
        return sainte_lague([float(x) for x in parts.words], [MOST_PASSES * int(x) for x in parts.blocks], int(parts.quota.iloc[0]))

    def to_groups(parts: pd.DataFrame) -> pd.DataFrame:
        """Quotas of one source's groups: a row for each group_shards * shard_words words of it."""
        parts = parts.sort_values("group")
        return pd.DataFrame({"source_no": parts.source_no.to_numpy(), "group": parts.group.to_numpy(), "quota": apportion(parts)})

    def to_shards(parts: pd.DataFrame) -> pd.DataFrame:
        """Quotas of one group's shards."""
        parts = parts.sort_values("shard")
        n, got = [int(x) for x in parts.blocks], apportion(parts)
        return pd.DataFrame({
            "source_no": parts.source_no.to_numpy(), "shard": parts.shard.to_numpy(), "blocks": n,
            "passes": [q // m for q, m in zip(got, n)], "rest": [q % m for q, m in zip(got, n)],
            "start": [_offset(seed, int(s), int(h), m) for s, h, m in zip(parts.source_no, parts.shard, n)],
        })

    cells = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    of = F.call_function("div", F.col("shard"), F.lit(group_shards)).cast("int")
    cells = cut(cells.select("source_no", "shard", "words", "quota", of.alias("group"), F.greatest(F.lit(1), F.ceil(F.col("words") / block_words)).cast("long").alias("blocks")))
    groups = cells.groupBy("source_no", "group").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"), F.first("quota").alias("quota"))
    groups = groups.groupBy("source_no").applyInPandas(to_groups, "source_no int, group int, quota long")
    shared = cells.drop("quota").join(groups, ["source_no", "group"])
    cells = cut(shared.groupBy("source_no", "group").applyInPandas(to_shards, "source_no int, shard int, blocks long, passes long, rest long, start long"))
    order = Window.partitionBy("source_no", "shard").orderBy("key", "doc_id", "size")
    laid = dealt.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = laid.join(cells, ["source_no", "shard"])
    extra = _chosen_before(F.col("end"), block_words) - _chosen_before(F.col("end") - F.col("size"), block_words)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + extra).cast("long").alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


#: The same mix, its quotients ranked one by one.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size) AS key FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, ({list(WEIGHTS)})[no % {len(WEIGHTS)} + 1] AS w, {MOST_PASSES} * source_size AS most, greatest(1, (source_size + {SHARD_WORDS - 1}) // {SHARD_WORDS}) AS shards FROM t),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY most / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM w),
c AS (SELECT *, rest * w > most * rest_w AS full_ FROM o),
f AS (SELECT arg_min(rest, most / w) AS rest, arg_min(rest_w, most / w) AS rest_w FROM c WHERE NOT full_),
g AS (SELECT c.*, CASE WHEN full_ THEN CAST(most AS DOUBLE) ELSE CAST(f.rest * w AS DOUBLE) / CAST(f.rest_w AS DOUBLE) END AS target FROM c, f),
q AS (SELECT no, target / (2 * k + 1) AS quotient FROM g, range({MOST_PASSES} * ((source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})) r(k)),
r AS (SELECT no, row_number() OVER (ORDER BY quotient DESC, no) AS place FROM q),
n AS (SELECT g.no, count(r.no) AS quota FROM g LEFT JOIN r ON r.no = g.no AND place <= (total + {BLOCK_WORDS // 2}) // {BLOCK_WORDS} GROUP BY g.no),
dealt AS (SELECT d.doc_id, d.size, d.key, g.no, g.source_size, g.target, n.quota, CAST('0x' || substr(d.key, 1, 7) AS BIGINT) % g.shards AS shard FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN n USING (no)),
cells AS (SELECT no, shard, CAST(sum(size) AS BIGINT) AS words, any_value(quota) AS quota, greatest(1, (CAST(sum(size) AS BIGINT) + {BLOCK_WORDS - 1}) // {BLOCK_WORDS}) AS blocks FROM dealt GROUP BY no, shard),
gs AS (SELECT no, shard // {GROUP_SHARDS} AS grp, CAST(sum(words) AS BIGINT) AS words, CAST(sum(blocks) AS BIGINT) AS blocks, any_value(quota) AS quota FROM cells GROUP BY no, grp),
gq AS (SELECT no, grp, quota, row_number() OVER (PARTITION BY no ORDER BY CAST(words AS DOUBLE) / (2 * k + 1) DESC, grp) AS place FROM gs, range({MOST_PASSES} * blocks) r(k) WHERE words > 0),
gn AS (SELECT no, grp, count(*) AS got FROM gq WHERE place <= quota GROUP BY no, grp),
cq AS (SELECT cells.no, shard, got AS quota, row_number() OVER (PARTITION BY cells.no, grp ORDER BY CAST(words AS DOUBLE) / (2 * k + 1) DESC, shard) AS place
    FROM cells JOIN gn ON gn.no = cells.no AND grp = shard // {GROUP_SHARDS}, range({MOST_PASSES} * blocks) r(k) WHERE words > 0),
cn AS (SELECT no, shard, count(*) AS got FROM cq WHERE place <= quota GROUP BY no, shard),
plan AS (SELECT no, shard, blocks, coalesce(got, 0) // blocks AS passes, coalesce(got, 0) % blocks AS rest, CAST('0x' || substr(md5('{SEED}:' || no || ':' || shard), 1, 7) AS BIGINT) % blocks AS start FROM cells LEFT JOIN cn USING (no, shard)),
laid AS (SELECT *, CAST(sum(size) OVER (PARTITION BY no, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS x1 FROM dealt),
e AS (SELECT *, x1 - size AS x0 FROM laid JOIN plan USING (no, shard))
SELECT doc_id, size, source_size, target, CAST(passes * size
    + (x1 // {BLOCK_WORDS} * rest + start) // blocks * {BLOCK_WORDS} + (((x1 // {BLOCK_WORDS} + 1) * rest + start) // blocks - (x1 // {BLOCK_WORDS} * rest + start) // blocks) * (x1 % {BLOCK_WORDS})
    - (x0 // {BLOCK_WORDS} * rest + start) // blocks * {BLOCK_WORDS} - (((x0 // {BLOCK_WORDS} + 1) * rest + start) // blocks - (x0 // {BLOCK_WORDS} * rest + start) // blocks) * (x0 % {BLOCK_WORDS}) AS BIGINT) AS taken FROM e
"""
