"""Views of job results for people: summary, signal cards, module rows, frames, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.checkpoint import cut
from . import jobs, report


def signal_cards(results: DataFrame) -> DataFrame:
    """results (job_id, probability, assessment, ela_max, lsb_detected) -> four rows a job, told apart:
    each says its own value or that it was not evaluated or does not apply."""
    none, not_applied = F.lit("not evaluated"), F.lit("not applied")
    card = lambda name, value: F.struct(F.lit(name).alias("signal"), value.alias("value"))
    cards = F.array(
        card("model", F.when(F.col("probability").isNotNull(), scalar.percent(F.col("probability"))).otherwise(none)),
        card("origin", F.coalesce(F.replace("assessment", F.lit("_"), F.lit(" ")), none)),
        card("ela", F.coalesce(F.concat(F.lit("max "), F.col("ela_max").cast("string")), not_applied)),
        card("lsb", F.coalesce(F.when(F.col("lsb_detected"), "payload found").when(~F.col("lsb_detected"), "no payload"), not_applied)),
    )
    return results.select("job_id", F.inline(cards))


#: What a finding's type in JSON is called; numbers are any of Spark's number types.
_SCALARS = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def kind(value: Column) -> Column:
    """string, boolean, null, number, object or array: the type of a variant."""
    t = F.schema_of_variant(value)
    told = F.when(F.startswith(t, F.lit("OBJECT<")), "object").when(F.startswith(t, F.lit("ARRAY<")), "array")
    for spark_name, name in _SCALARS.items():
        told = told.when(t == spark_name, name)
    return told.otherwise("number")


def findings(results: DataFrame, depth: int = 6) -> DataFrame:
    """results (job_id, modules with findings as JSON) -> job_id, module, path, kind, value: a row for each scalar, however
    deep, its path joined by dots with places of arrays as numbers from 0.

    value is the scalar as text, null for a null. What is deeper than `depth` levels is a row as it stands, as JSON, with
    kind object or array, as are empty objects and arrays. Findings that are not JSON have no rows.
    """
    spark = results.sparkSession
    top = results.select("job_id", F.explode("modules").alias("m")).select("job_id", "m.module", "m.findings")
    # Findings are narrow; cut, they are parsed level by level without another look at the media.
    level = cut(top).select("job_id", "module", F.lit("").alias("path"), F.try_parse_json("findings").alias("v")).filter("v IS NOT NULL")
    out = []
    for no in range(depth):
        each = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.coalesce("key", F.col("pos").cast("string"))
        found = each.select("job_id", "module", F.when(F.col("path") == "", step).otherwise(F.concat_ws(".", "path", step)).alias("path"), kind(F.col("value")).alias("kind"), F.col("value").alias("v"))
        nested = F.col("kind").isin("object", "array") & ~F.to_json("v").isin("{}", "[]")
        out.append(found if no == depth - 1 else found.filter(~nested))
        level = found.filter(nested).select("job_id", "module", "path", "v")
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.select("job_id", "module", "path", "kind", F.when(F.col("kind") != "null", F.col("v").cast("string")).alias("value"))


def module_rows(results: DataFrame) -> DataFrame:
    """results (job_id, modules with findings as JSON) -> module, status, detail: scalar findings joined by
    ` · ` without assessment and decision; warnings for modules that did not complete. A text is a scalar whatever it
    looks like."""
    m = results.select("job_id", F.explode("modules").alias("m"))
    entries = F.map_entries(F.from_json("m.findings", "map<string,variant>"))
    scalars = F.filter(entries, lambda e: ~e["key"].isin("assessment", "decision") & kind(e["value"]).isin("string", "number", "boolean"))
    told = F.array_join(F.transform(scalars, lambda e: F.concat(F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit(": "), e["value"].cast("string"))), " · ")
    return m.select("job_id", "m.module", "m.status", F.when(F.col("m.status") == "completed", told).otherwise(F.array_join("m.warnings", " · ")).alias("detail"))


def frame_table(frames: DataFrame) -> DataFrame:
    """frames (job_id, frame_index, timestamp_seconds, probability): times to two places, a dash for no score."""
    return frames.select("job_id", "frame_index", F.format_string("%.2f", "timestamp_seconds").alias("at"), scalar.percent(F.col("probability")).alias("score"))


def history(ledger: DataFrame, text: str = "", status: str | None = None, limit: int = 100) -> DataFrame:
    """Rows of the history table with how many of the fetched jobs they are."""
    fetched, found = jobs.recent(ledger, limit), jobs.search(ledger, text, status, limit)
    counts = fetched.agg(F.count("*").alias("fetched")).crossJoin(found.agg(F.count("*").alias("shown")))  # single rows
    return found.crossJoin(counts)


def summary(results: DataFrame) -> DataFrame:
    """results (job_id, status, media_type, assessment, probability, analysed_faces, lsb_detected, modules)
    -> headline, badge and state of each case."""
    model: Column = report.module_named(F.col("modules"), "deepfake_detection")["status"]
    badge = F.when(F.col("assessment") == "strong_ai_origin_evidence", "origin").when(F.col("assessment") == "unverified_ai_origin_claim", "claim").when(F.col("probability").isNotNull(), "score").otherwise("none")
    media = F.when(F.startswith("media_type", F.lit("video/")), "video").otherwise("image")
    return results.select(
        "job_id", report.headline(F.col("assessment"), F.col("probability"), model).alias("headline"), badge.alias("badge"), F.replace("status", F.lit("_"), F.lit(" ")).alias("state"), media.alias("media"),
        F.coalesce(F.col("analysed_faces").cast("string"), F.lit("—")).alias("faces"), F.when(F.col("lsb_detected"), "payload found").when(~F.col("lsb_detected"), "no payload").otherwise("not applied").alias("low_bits"),
    )


def summary_lines(row: DataFrame) -> DataFrame:
    """Each column of a one-row summary as a line of text, in order."""
    lines = F.array(*[F.concat(F.lit(c.replace("_", " ") + ": "), F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))) if row.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c).cast("string"), F.lit("none"))) for c in row.columns])
    return row.select(F.posexplode(lines).alias("line_no", "line"))
