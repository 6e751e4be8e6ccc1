"""Evaluations of manifests: what a manifest expects, joined with what the operators find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dct
from ..functions.checkpoint import cut
from . import forensics, imaging, ingest, metrics, rollups

CLEAN = ("clean", "clean-noise")
UNSUPPORTED = "unsupported-"


def hidden_cases(cases: DataFrame, found: DataFrame) -> DataFrame:
    """cases (id, file, category, expected_supported_payload, payload_sha256, …) ⋈ found (file, method, payload)
    -> the case with what was found and its outcome. A file that was not read counts as nothing found."""
    expected = F.coalesce("expected_supported_payload", F.lit(False))
    actual = F.col("payload").isNotNull()
    same = actual & F.coalesce(F.sha2("payload", 256) == F.col("payload_sha256"), F.lit(False))
    joined = cases.join(found.select("file", "method", "payload"), "file", "left")
    return joined.select(
        *cases.columns, actual.alias("actual_supported_payload"), F.sha2("payload", 256).alias("extracted_payload_sha256"), F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("extracted_size"),
        F.when(expected, same).alias("payload_correct"), F.col("method").alias("extraction_method"), rollups.stego_outcome(expected, actual, same).alias("outcome"),
    )


def hidden_summary(evaluated: DataFrame) -> DataFrame:
    """hidden_cases -> one row of counts and rates in percent, to two places."""
    e, a, c = F.coalesce("expected_supported_payload", F.lit(False)), F.col("actual_supported_payload"), F.coalesce("payload_correct", F.lit(False))
    clean, other = F.col("category").isin(*CLEAN), F.startswith("category", F.lit(UNSUPPORTED))
    n = evaluated.agg(
        F.count("*").alias("total_cases"), F.count_if(e).alias("supported_case_count"), F.count_if(e & a).alias("supported_payloads_detected"), F.count_if(e & c).alias("correct_payload_count"),
        F.count_if(clean).alias("clean_case_count"), F.count_if(clean & a).alias("clean_false_positive_count"), F.count_if(F.col("outcome") == "FALSE_NEGATIVE").alias("false_negative_count"),
        F.count_if(F.col("outcome") == "INCORRECT_PAYLOAD").alias("incorrect_payload_count"), F.count_if(other).alias("unsupported_case_count"), F.count_if(other & a).alias("unsupported_detection_count"),
    )
    rate = lambda part, of: F.round(rollups.percentage(F.col(part), F.col(of)), 2)
    return n.select(
        "*", rate("supported_payloads_detected", "supported_case_count").alias("supported_extraction_success_rate_percent"), rate("correct_payload_count", "supported_case_count").alias("payload_correctness_rate_percent"),
        rate("clean_false_positive_count", "clean_case_count").alias("clean_false_positive_rate_percent"),
    )


def images_payloads(decoded: DataFrame) -> DataFrame:
    """Decoded images (path, image) -> file, method, payload."""
    bits = decoded.select(F.col("path").alias("file"), imaging.low_bits(F.col("image"))["head"].alias("head"))
    return bits.select("file", forensics.payload(F.col("head")).alias("h")).select("file", "h.method", "h.payload")


def recompressed_cases(cases: DataFrame, files: DataFrame, decoded: DataFrame, codec: imaging.Codec = dct.recoded, quality: int = imaging.QUALITY, threshold: int = imaging.THRESHOLD) -> DataFrame:
    """cases (id, file, known_edit, known_edit_region_xyxy, image_sha256, …) with their files' error statistics,
    and those of the known region against the rest. All cases have this quality and threshold.

    A file that is missing, differs from its hash or can't be decoded ends the evaluation.
    """
    hashed = ingest.verify_hashes(cases.select("file", F.col("image_sha256").alias("sha256")), files, key="file").select("file", "status")
    joined = cases.join(hashed, "file").join(decoded.select(F.col("path").alias("file"), "image"), "file", "left")
    told = joined.withColumn("e", imaging.recompression(F.col("image"), codec, quality, threshold, F.col("known_edit_region_xyxy")))
    broken = F.when(F.col("status") != "ok", F.concat(F.lit("image checksum mismatch for "), "id")).when(F.coalesce(F.col("e.mean_error").isNull(), F.lit(True)), F.concat(F.lit("image not decoded for "), "id"))
    sound = told.filter(F.when(broken.isNotNull(), F.raise_error(broken).isNull()).otherwise(F.lit(True)))
    means = lambda k: F.round(F.col(f"e.{k}"), 4)
    return sound.select(
        *cases.columns, F.round("e.mean_error", 4).alias("mean_error"), F.round("e.p95_error", 4).alias("p95_error"), F.col("e.max_error").alias("max_error"), F.round("e.highlighted_ratio", 6).alias("highlighted_ratio"),
        means("region_mean").alias("region_mean"), means("background_mean").alias("background_mean"), F.round(F.try_divide("e.region_mean", "e.background_mean"), 4).alias("region_ratio"), F.col("e.heatmap").alias("heatmap"),
    )


def recompressed_summary(evaluated: DataFrame, listed: bool = True) -> DataFrame:
    """One row: the one known edit against the benign cases; another number of known edits is an error. Benign cases that
    reach the edit are listed by id, as a manifest has few; listed=False counts them, for tables of any size. Of equally
    strong benign cases the one of least id is told. The measured rows are cut once, so no image is coded again."""
    evaluated = cut(evaluated.drop("heatmap"))
    edits = evaluated.filter("known_edit").count()
    if edits != 1:
        raise ValueError(f"one known edit is wanted, not {edits}")
    edited = evaluated.filter("known_edit").select(*[F.col(c).alias(f"edited_{c}") for c in ("id", "mean_error", "p95_error", "max_error", "highlighted_ratio", "region_mean", "background_mean", "region_ratio")])
    benign = evaluated.filter("NOT known_edit").crossJoin(F.broadcast(edited))  # one row
    ids = (lambda when: F.array_sort(F.collect_list(F.when(when, F.col("id"))))) if listed else F.count_if
    best = lambda c: F.min_by(F.struct("id", F.col(c).alias("value")), F.struct((-F.col(c)).alias("c"), "id"))
    return benign.groupBy(*edited.columns).agg(
        F.count("*").alias("benign_case_count"), ids(F.col("highlighted_ratio") > 0).alias("benign_with_highlighted_pixels"), ids(F.col("highlighted_ratio") >= F.col("edited_highlighted_ratio")).alias("benign_meeting_edited_ratio"),
        ids(F.col("p95_error") >= F.col("edited_p95_error")).alias("benign_meeting_edited_p95"), best("highlighted_ratio").alias("strongest_benign_by_ratio"), best("p95_error").alias("strongest_benign_by_p95"),
    )


def scored_catalog(catalog: DataFrame, decoded: DataFrame, cropper: Callable, model: Callable, threshold: float, *, batch: int = 4) -> DataFrame:
    """catalog (sample_id, path, label, …) -> its rows with score (to eight places), prediction and status:
    evaluated, no_face or read_error. Paths that leave the data's root are an error. Rows that repeat a sample_id, or have
    none, are each scored. An image is cropped and scored by one worker, and no row is joined with its own score."""
    unsafe = catalog.filter(~ingest.stays_inside(F.col("path")))
    if not unsafe.isEmpty():
        raise ValueError("a path leaves the data root")
    score = F.lit(None).cast("double") if model is None else imaging.face_scores(F.col("image"), cropper, model, batch=batch)
    scored = catalog.join(decoded.select("path", "image"), "path", "left").select(*catalog.columns, F.col("image.data").isNotNull().alias("_readable"), score.alias("_score"))
    scored = scored.select(*catalog.columns, "_readable", F.round("_score", 8).alias("score"))
    status = F.when(~F.col("_readable"), "read_error").when(F.col("score").isNull(), "no_face").otherwise("evaluated")
    return scored.select(*catalog.columns, "score", (F.col("score") >= threshold).cast("int").alias("prediction"), status.alias("status"))


def catalog_metrics(rows: DataFrame, threshold: float) -> DataFrame:
    """One row: status counts and all metrics of the evaluated rows; an error if there are none."""
    rows = cut(rows.select("label", "score", "status"))  # each aggregate reads these, none runs the model again
    measured = metrics.evaluate(rows.filter("status = 'evaluated'").select("label", "score"), threshold)
    return metrics.status_counts(rows).crossJoin(measured)  # single rows
