"""Dataset catalogue: labels, identities, rejects, connected records, leakage-free splits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoint import cut, stored
from ..functions.graph import connected_components
from . import ingest

FAKE, REAL = ("1", "fake", "manipulated", "deepfake"), ("0", "real", "authentic", "original")
SPLITS = ("train", "validation", "test")


def label(text: Column) -> Column:
    """1 for fake, 0 for real, null for anything else."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*FAKE), 1).when(t.isin(*REAL), 0)


def identities(text: Column) -> Column:
    """Distinct identities of a `;` list, trimmed and in order; empty if none."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")))


def manipulation(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("unspecified"))


def sample_id(dataset: str, sha256: Column, line: Column) -> Column:
    return F.concat(F.lit(f"{dataset}-"), F.substring(sha256, 1, 16), F.lit("-"), F.format_string("%06d", line))


def build(metadata: DataFrame, files: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """metadata (line, path, label, identity_ids, source_group, manipulation) and files (path, content)
    -> (catalogue, rejects (line, reason)). Of rows that repeat a path or a content, the first line stays."""
    path, text = F.col("path"), F.col("label")
    read = metadata.join(files.select("path", F.sha2("content", 256).alias("sha256")), "path", "left")
    reason = (
        F.when(label(text).isNull(), "bad_label").when(F.size(identities(F.col("identity_ids"))) < 1, "no_identity").when(~F.coalesce(ingest.stays_inside(path), F.lit(False)), "unsafe_path")
        .when(~ingest.image_suffix(path), "bad_suffix").when(F.col("sha256").isNull(), "missing_file")
    )
    told = read.withColumn("reason", reason)
    for key, again in (("path", "duplicate_path"), ("sha256", "duplicate_content")):
        first = told.filter("reason IS NULL").groupBy(key).agg(F.min("line").alias("_first"))
        told = told.join(first, key, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("line") > F.col("_first"), F.concat(F.lit(f"{again} of line "), F.col("_first").cast("string"))))).drop("_first")
    told = cut(told)
    good = told.filter("reason IS NULL").select(
        sample_id(dataset, F.col("sha256"), F.col("line") - 1).alias("sample_id"), "path", label(text).alias("label"), identities(F.col("identity_ids")).alias("identity_ids"), "source_group",
        F.lit(dataset).alias("dataset"), manipulation(F.col("manipulation")).alias("manipulation"), "sha256",
    )
    return good, told.filter("reason IS NOT NULL").select("line", "reason")


def label_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("label").agg(F.count("*").alias("n"))


def constraints(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, constraint): everything that two records must not share across splits; arrays give each element."""
    parts = []
    for c in columns:
        value = F.explode(c) if records.schema[c].dataType.typeName() == "array" else F.col(c)
        parts.append(records.select(F.col(key).alias("key"), value.alias("v")).select("key", F.concat_ws(":", F.lit(c), F.col("v").cast("string")).alias("constraint")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def components(rows: DataFrame) -> DataFrame:
    """(key, constraint) -> (key, component), the least key of those connected through constraints.

    Constraints, told by their least records, are the nodes: a record links those that it holds to the least of them, so
    records of one constraint link nothing and only those of several take part in the rounds. The least key of a
    component is the least record of a constraint.
    """
    least = rows.groupBy("constraint").agg(F.min("key").alias("b"))
    alone = rows.filter("constraint IS NULL").select("key", F.lit(None).cast(rows.schema["key"].dataType).alias("b"))
    pairs = stored(rows.join(least, "constraint").select("key", "b").unionByName(alone))
    held = pairs.groupBy("key").agg(F.min("b").alias("b"), F.max("b").alias("most"))
    links = pairs.withColumnRenamed("b", "a").join(held.filter("b < most").select("key", "b"), "key").select("a", "b")
    found = connected_components(links).withColumnRenamed("node", "b")
    return held.select("key", "b").join(found, "b", "left").select("key", F.coalesce("component", "b", "key").alias("component"))


def leaks(rows: DataFrame) -> DataFrame:
    """(constraint, split) -> constraints that more than one split holds."""
    return rows.groupBy("constraint").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def first_of(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Adds first_line, the line where the row's key was first seen (a grouped minimum, joined back)."""
    return rows.join(rows.groupBy(key).agg(F.min(line).alias("first_line")), key)


def _check(ratios: tuple[float, float, float]) -> None:
    if any(r <= 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must be positive and sum to 1")


def _cost(have: list[int], counts: list[int], totals: tuple[int, int], share: float) -> tuple[float, int]:
    """How far a split of this share is from its size and its labels' counts with `counts` added, and what it holds."""
    error = abs(sum(have) + sum(counts) - sum(totals) * share) / max(sum(totals) * share, 1)
    error += sum(abs(have[y] + counts[y] - totals[y] * share) / max(totals[y] * share, 1) for y in (0, 1) if totals[y])
    return error, sum(have)


def assign_splits(sizes: list[tuple[int, int, int]], ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 2205) -> dict[int, str]:
    """component -> split, from (component, reals, fakes) in order of component.

    The three largest (after a seeded shuffle) open the splits; each further one goes where sizes
    and labels stay nearest their shares, then to the smallest split. Counters are kept as it goes.
    """
    _check(ratios)
    if len(sizes) < len(SPLITS):
        raise ValueError("fewer than three disconnected groups")
    order = sorted(sizes)
    random.Random(seed).shuffle(order)
    order.sort(key=lambda c: -(c[1] + c[2]))
    totals = (sum(c[1] for c in order), sum(c[2] for c in order))
    held = {s: [0, 0] for s in SPLITS}
    out: dict[int, str] = {}

    for i, (component, *counts) in enumerate(order):
        split = SPLITS[i] if i < len(SPLITS) else min(SPLITS, key=lambda s: _cost(held[s], counts, totals, ratios[SPLITS.index(s)]))
        out[component] = split
        held[split] = [a + b for a, b in zip(held[split], counts)]
    return out


def split_quotas(classes: list[tuple[int, int, int]], ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> list[tuple[int, int, int, int, int]]:
    """(reals, fakes, components of that size) -> (reals, fakes, how many of them go to each split).

    The rule of assign_splits, with the classes of one size mixed evenly in place of its shuffle. Components
    of a class are alike, so counts say it all: many go by shares of 1/128 of what is left, the last 255 one by one.
    """
    _check(ratios)
    if sum(n for *_, n in classes) < len(SPLITS):
        raise ValueError("fewer than three disconnected groups")
    totals = (sum(r * n for r, _, n in classes), sum(f * n for _, f, n in classes))
    held, opened, out = [[0, 0] for _ in SPLITS], 0, []
    sized: dict[int, list[tuple[int, int, int]]] = {}
    for c in sorted(classes):
        sized.setdefault(c[0] + c[1], []).append(c)
    for _, group in sorted(sized.items(), reverse=True):
        left, quota = [n for *_, n in group], [[0] * len(SPLITS) for _ in group]
        while any(left):
            k = max(range(len(group)), key=lambda k: left[k] / group[k][2])  # noqa: B023
            r, f, step = *group[k][:2], 1
            if opened < len(SPLITS):
                at, opened = opened, opened + 1
            else:
                step = max(1, left[k] // 128)
                at = min(range(len(SPLITS)), key=lambda s: _cost(held[s], [r * step, f * step], totals, ratios[s]))  # noqa: B023
            quota[k][at] += step
            held[at] = [held[at][0] + r * step, held[at][1] + f * step]
            left[k] -= step
        out += [(r, f, *q) for (r, f, _), q in zip(group, quota)]
    return out


def split_components(records: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 2205, bucket_size: int = 10_000) -> DataFrame:
    """records (component, label) -> (component, split) by split_quotas.

    Only counts by (reals, fakes) come to the driver. In a class, components are ranked by a seeded
    hash, in buckets of about bucket_size, and the first ranks go to train, the next to validation.
    """
    sizes = cut(records.groupBy("component").agg(F.count_if(F.col("label") == 0).alias("r"), F.count_if(F.col("label") == 1).alias("f")))
    classes = [(c["r"], c["f"], c["n"]) for c in sizes.groupBy("r", "f").agg(F.count("*").alias("n")).collect()]
    quotas = records.sparkSession.createDataFrame(split_quotas(classes, ratios), "r long, f long, train long, validation long, test long")
    h = F.xxhash64(F.lit(seed), "component")
    buckets = max(1, sum(n for *_, n in classes) // bucket_size)
    dealt = sizes.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    earlier = Window.partitionBy("r", "f").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("r", "f", "bucket").agg(F.count("*").alias("n")).select("r", "f", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("r", "f", "bucket").orderBy("h", "component")
    ranked = dealt.withColumn("no", F.row_number().over(within)).join(starts, ["r", "f", "bucket"]).withColumn("rank", F.col("start") + F.col("no"))
    split = F.when(F.col("rank") <= F.col("train"), SPLITS[0]).when(F.col("rank") <= F.col("train") + F.col("validation"), SPLITS[1]).otherwise(SPLITS[2])
    return ranked.join(F.broadcast(quotas), ["r", "f"]).select("component", split.alias("split"))


def split_summary(records: DataFrame) -> DataFrame:
    """records (split, label, identity_ids, source_group) -> counts by split."""
    base = records.groupBy("split").agg(
        F.count("*").alias("samples"), F.count_if(F.col("label") == 0).alias("real"), F.count_if(F.col("label") == 1).alias("fake"), F.count_distinct("source_group").alias("source_groups")
    )
    people = records.select("split", F.explode("identity_ids").alias("i")).groupBy("split").agg(F.count_distinct("i").alias("identities"))
    return base.join(people, "split", "left").select("split", "samples", "real", "fake", F.coalesce("identities", F.lit(0).cast("long")).alias("identities"), "source_groups")
