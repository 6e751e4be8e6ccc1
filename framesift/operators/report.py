"""Reports and views of results: modules, warnings, artifacts, metadata, lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

MODULES = ("media_authenticity", "deepfake_detection", "image_forensics")


def union_modules(results: list[DataFrame]) -> DataFrame:
    """Rows of all analyzers' results, by column name."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def warnings(result_warnings: Column, modules: Column) -> Column:
    """A result's own warnings, then those of its modules."""
    return F.concat(result_warnings, F.flatten(F.transform(modules, lambda m: m["warnings"])))


def artifacts(modules: Column) -> Column:
    return F.flatten(F.transform(modules, lambda m: m["artifacts"]))


def module_named(modules: Column, name: str) -> Column:
    return F.get(F.filter(modules, lambda m: m["module"] == name), F.lit(0))


def metadata_rows(rows: DataFrame, key: str, nested: str) -> DataFrame:
    """nested: map<string, map<string, string>> -> key, label `group / tag`, value; one row if there is none."""
    entries = rows.select(key, F.explode_outer(nested).alias("group", "tags")).select(key, "group", F.explode_outer("tags").alias("tag", "value"))
    label_ = F.when(F.col("group").isNull(), "Metadata").otherwise(F.concat_ws(" / ", F.replace("group", F.lit("_"), F.lit(" ")), "tag"))
    return entries.select(key, label_.alias("label"), F.when(F.col("group").isNull(), "No metadata available for this case").otherwise(F.coalesce("value", F.lit("Unavailable"))).alias("value"))


def report_lines(jobs: DataFrame) -> DataFrame:
    """jobs -> id, line_no, line: the head of a job's report in its fixed order."""
    lines = F.array(
        F.lit("Forensic Risk Assessment"), F.concat(F.lit("Analysis ID: "), "id"), F.concat(F.lit("Status: "), "status"), F.concat(F.lit("Source: "), "source_name"),
        F.concat(F.lit("Media type: "), "media_type"), F.concat(F.lit("SHA-256: "), "sha256"), F.concat(F.lit("Size: "), F.col("size_bytes").cast("string"), F.lit(" bytes")),
        F.concat(F.lit("Created: "), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS")),
    )
    return jobs.select("id", F.posexplode(lines).alias("line_no", "line"))


LIMITATION = "Limitation: this report holds forensic risk indicators, not conclusive proof of authenticity or manipulation."
SCORE_NOTE = "This score does not measure whole-media AI-generation probability."


def full_report(jobs: DataFrame, width: int = 92) -> DataFrame:
    """jobs with results -> id, line_no, line: the whole report in its fixed order, wrapped at `width`.

    jobs: id, status, source_name, media_type, sha256, size_bytes, created_at, and result: null, or a struct of
    code_version, analysed_at, width, height, duration_seconds, frame_rate (the last two null for stills),
    sampled_frames, modules (module, status, version, duration_ms, settings and findings as JSON, warnings)
    and warnings.
    """
    r = F.col("result")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    moment = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    some = lambda when, *lines: F.when(when, F.array(*lines)).otherwise(F.array().cast("array<string>"))
    given = lambda json: json.isNotNull() & (json != "{}")

    def module(m: Column) -> Column:
        score = F.get_json_object(m["findings"], "$.deepfake_probability").cast("double")
        scored = (m["module"] == "deepfake_detection") & score.isNotNull()
        return F.concat(
            F.array(text(m["module"], ": ", m["status"]), text("Version: ", m["version"], "; duration: ", m["duration_ms"].cast("string"), " ms")), some(given(m["settings"]), text("Settings: ", m["settings"])),
            some(scored, text("Face-manipulation model score: ", scalar.percent(score)), F.lit(SCORE_NOTE)), F.transform(m["warnings"], lambda w: text("Warning: ", w)), some(given(m["findings"]), m["findings"]),
        )

    head = F.array(
        F.lit("Forensic Risk Assessment"), text("Analysis ID: ", F.col("id")), text("Status: ", F.col("status")), text("Source: ", F.col("source_name")), text("Media type: ", F.col("media_type")),
        text("SHA-256: ", F.col("sha256")), text("Size: ", F.col("size_bytes").cast("string"), " bytes"), text("Created: ", moment(F.col("created_at"))),
    )
    media = F.concat(
        F.array(F.lit("Media"), text("Code version: ", r["code_version"]), text("Analysed: ", moment(r["analysed_at"])), text("Dimensions: ", r["width"].cast("string"), " x ", r["height"].cast("string"))),
        some(r["duration_seconds"].isNotNull(), text("Duration: ", F.format_string("%.3f", r["duration_seconds"]), " seconds"), text("Frame rate: ", r["frame_rate"].cast("string"), " FPS"), text("Sampled frames: ", r["sampled_frames"].cast("string"))),
    )
    body = F.concat(media, F.array(F.lit("Module findings")), F.flatten(F.transform(r["modules"], module)), F.when(F.size(r["warnings"]) > 0, F.concat(F.array(F.lit("Analysis warnings")), r["warnings"])).otherwise(F.array().cast("array<string>")))
    lines = F.concat(head, F.when(r.isNotNull(), body).otherwise(F.array().cast("array<string>")), F.array(F.lit(LIMITATION)))
    return jobs.select("id", F.posexplode(F.flatten(F.transform(lines, lambda x: scalar.wrapped(x, width)))).alias("line_no", "line"))


def json_report(jobs: DataFrame, disclaimer: str) -> DataFrame:
    """One JSON document a job; null fields are kept."""
    body = F.struct(F.lit("forensic_risk_assessment").alias("report_type"), F.lit(disclaimer).alias("disclaimer"), F.struct(*jobs.columns).alias("analysis"))
    return jobs.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def headline(assessment: Column, probability: Column, model_status: Column) -> Column:
    """One line for a case; origin evidence and the model's score are told apart, never blended."""
    return (
        F.when(assessment == "strong_ai_origin_evidence", "Strong AI-origin evidence")
        .when(assessment == "unverified_ai_origin_claim", "Unverified AI-origin claim")
        .when((model_status == "completed") & probability.isNotNull(), F.concat(F.lit("Model score "), F.format_string("%.1f%%", probability * 100)))
        .otherwise("Inconclusive")
    )
