"""Analyzers: each adds one module result to a table of media; results stay apart and failures stay local.

An analyzer is a column over media rows, so a file's content is read once for all of them and nothing is
shuffled; what its column names more than once it may prepare as columns of its own. Media has job_id, media_type and content; what else analyzers read (image, header, watermark,
faces) is null where it was not prepared.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dct
from . import forensics, headers, imaging, jobs, scoring, video, watermark

ARTIFACT = "struct<kind:string,name:string,content:binary>"
MODULE = f"struct<module:string,status:string,version:string,settings:string,findings:string,artifacts:array<{ARTIFACT}>,warnings:array<string>>"
#: Prepared columns of media with their types.
PREPARED = {"image": imaging.IMAGE, "header": headers.HEADER, "watermark": watermark.RESULT, "faces": video.FACES}


class Analyzer(Protocol):
    """name: the module it reports. apply: media -> its result as a column (MODULE). An analyzer may also have
    prepare: media -> media with further columns that apply reads."""

    name: str

    def apply(self, media: DataFrame) -> Column: ...


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _nested(**parts: Column) -> Column:
    """JSON object of parts that are JSON already; null ones are left out."""
    each = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *each), F.lit("}"))


def _told(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(when, F.lit(text)) for when, text in pairs]))


def result(name: str, status: Column, findings: Column, warnings: Column, *, version: str = "1", settings: Column | None = None, artifacts: Column | None = None) -> Column:
    none = F.lit("{}")
    return F.struct(
        F.lit(name).alias("module"), status.alias("status"), F.lit(version).alias("version"), (none if settings is None else settings).alias("settings"), findings.alias("findings"),
        (F.array() if artifacts is None else artifacts).cast(f"array<{ARTIFACT}>").alias("artifacts"), warnings.cast("array<string>").alias("warnings"),
    ).cast(MODULE)


class Unavailable:
    """Stands in for an analyzer that can't run here: every row is skipped with the reason."""

    def __init__(self, name: str, reason: str) -> None:
        self.name, self.reason = name, reason

    def apply(self, media: DataFrame) -> Column:
        return result(self.name, F.lit("skipped"), F.lit("{}"), F.array(F.lit(self.reason)))


class Authenticity:
    """A visible generator mark, and provenance claims in the file's head and tail; a claim is a lead, its
    signature is never checked. Always completed: without a decoded frame there is just no mark. A still with a mark
    comes with a picture of where it is."""

    name = "media_authenticity"

    def prepare(self, media: DataFrame) -> DataFrame:
        # Only where there is a mark is the image drawn on, and so read, at all.
        box = F.when(F.col("watermark.found"), F.col("watermark.box"))
        drawn = imaging.with_box(F.when(box.isNotNull(), F.col("image")), box)
        return media.withColumn("_provenance", forensics.provenance(F.col("content"))).withColumn("_marked", drawn)

    def apply(self, media: DataFrame) -> Column:
        p, w = F.col("_provenance"), F.col("watermark")
        mark, claim = F.coalesce(w["found"], F.lit(False)), F.size(p["ai_claims"]) > 0
        findings = _nested(
            assessment=_quoted(scoring.assessment(mark, claim)),
            visible_watermark=_json(candidate_detected=mark, match_score=F.coalesce(w["score"], F.lit(0.0)), location=w["location"], bounding_box=w["box"], analysed_frames=F.coalesce(w["frames"], F.lit(0))),
            provenance=F.to_json(p, {"ignoreNullFields": "false"}),
        )
        told = _told(
            (mark, "visible generator mark found: strong evidence of origin, to be confirmed with the provider's own verification"),
            (~mark & ~claim, "no known mark or claim was found, which does not show that the media is real"),
            (claim, "AI-origin claim found; its signature was not verified"),
            (~claim & (F.size(p["providers"]) > 0), "provider named without a claim"),
        )
        settings = _json(video_threshold=F.lit(watermark.ENOUGH), image_threshold=F.lit(watermark.ENOUGH_ALONE), scan_bytes=F.lit(forensics.SCAN_BYTES), most_frames=F.lit(watermark.FRAMES), most_edge=F.lit(watermark.EDGE))
        png = F.col("_marked.png")
        artifacts = F.array_compact(F.array(F.when(png.isNotNull(), F.struct(F.lit("watermark_evidence").alias("kind"), F.lit("visible-watermark.png").alias("name"), png.alias("content")))))
        return result(self.name, F.lit("completed"), findings, told, settings=settings, artifacts=artifacts)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


class Deepfake:
    """Face scores of a prepared model (video.face_scores). Skipped, never scored, without a model or a face."""

    name = "deepfake_detection"

    def __init__(self, threshold: float = 0.5, validated: bool = False) -> None:
        self.threshold, self.validated = threshold, validated

    def apply(self, media: DataFrame) -> Column:
        f = F.col("faces")
        scored = f["probability"].isNotNull()
        share = scoring.coverage(f["analysed_faces"], f["candidate_frames"])
        findings = _json(
            deepfake_probability=F.round(f["probability"], 6), decision=scoring.decision(f["probability"], self.threshold, self.validated), analysed_faces=f["analysed_faces"],
            candidate_frames=f["candidate_frames"], face_coverage=F.round(share, 6), top_frame=f["top_frame"], frame_scores=f["frame_scores"],
        )
        told = _told(
            (f.isNull(), "no face model has looked at this media"), (f.isNotNull() & ~scored, "no face was found"), (scored & F.lit(not self.validated), "the model's threshold is not validated; no decision is made"),
            (scored & (share < 1), "faces were found in part of the frames only"),
        )
        return result(self.name, F.when(scored, "completed").otherwise("skipped"), F.when(scored, findings).otherwise("{}"), told, settings=_json(threshold=F.lit(self.threshold), validated=F.lit(self.validated)))


class ImageForensics:
    """Metadata of all media; low bits with hidden payloads and, where there is a codec, the recompression
    error of decoded stills. A still that could not be decoded fails."""

    name = "image_forensics"

    def __init__(self, codec: imaging.Codec | None = dct.recoded, quality: int = imaging.QUALITY, threshold: int = imaging.THRESHOLD) -> None:
        self.codec, self.quality, self.threshold = codec, quality, threshold

    def prepare(self, media: DataFrame) -> DataFrame:
        image = F.col("image")
        error = imaging.recompression(image, self.codec, self.quality, self.threshold) if self.codec else F.lit(None).cast("struct<mean_error:double,p95_error:double,max_error:int,highlighted_ratio:double,heatmap:binary,error:string>")
        measured = media.withColumn("_bits", imaging.low_bits(image)).withColumn("_error", error)
        shown = imaging.as_png(image, F.col("_error.heatmap")) if self.codec else F.lit(None).cast("struct<png:binary,error:string>")
        return measured.withColumn("_shown", shown).withColumn("_hidden", F.when(F.col("_bits.head").isNotNull(), forensics.payload(F.col("_bits.head"))))

    def apply(self, media: DataFrame) -> Column:
        still, image = F.startswith("media_type", F.lit("image/")), F.col("image")
        bits, hidden, error = F.col("_bits"), F.col("_hidden"), F.col("_error")
        by_channel = F.to_json(F.map_from_arrays(F.array(*map(F.lit, imaging.CHANNELS)), F.arrays_zip(F.transform(bits["ones_ratio"], _six).alias("ones_ratio"), F.transform(bits["pair_imbalance"], _six).alias("pair_imbalance"))))
        low = _nested(
            inspected_bit_plane=F.lit("0"), available_lsb_bits=bits["bits"].cast("string"), channel_statistics=by_channel, packed_stream_entropy=_six(bits["entropy"]).cast("string"),
            supported_payload_detected=hidden["payload"].isNotNull().cast("string"), extraction_method=F.coalesce(_quoted(hidden["method"]), F.lit("null")),
            extracted_size_bytes=F.coalesce(F.octet_length(hidden["payload"]), F.lit(0)).cast("string"), ascii_preview=F.coalesce(F.get(F.regexp_extract_all(_json(x=forensics.preview(hidden["payload"])), F.lit(r'^\{"x":(.*)\}$'), 1), F.lit(0)), F.lit("null")),
        )
        ela = F.when(error.isNotNull(), _json(jpeg_quality=F.lit(self.quality), mean_error=F.round(error["mean_error"], 4), percentile_95_error=F.round(error["p95_error"], 4), max_error=error["max_error"], highlighted_pixel_ratio=_six(error["highlighted_ratio"])))
        failure = F.when(still, F.coalesce(bits["error"], error["error"], F.when(image.isNull() | bits["bits"].isNull(), "image could not be decoded")))
        findings = _nested(metadata=F.when(F.col("header").isNotNull(), headers.metadata(F.col("header"), still)), ela=ela, lsb=F.when(still, low))
        told = _told(
            (~still, "pixel analyses apply to still images; of videos only metadata is told"), (hidden["payload"].isNotNull(), "supported payload found; its bytes were taken out and never run"),
            (still & F.lit(self.codec is None), "no codec for recompression: error levels were not measured"), (error.isNotNull() & (F.col("media_type") == "image/png"), "error levels of a PNG compare it with a coding it never had"),
        )
        artifact = lambda kind, name, content: F.when(content.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), content.alias("content")))
        artifacts = F.array_compact(F.array(artifact("ela_heatmap", "ela-heatmap.png", F.col("_shown.png")), artifact("extracted_payload", "extracted-lsb-payload.bin", hidden["payload"])))
        failed = result(self.name, F.lit("failed"), F.lit("{}"), F.array(failure))
        settings = _json(ela_jpeg_quality=F.lit(self.quality), lsb_bit_plane=F.lit(0))
        return F.when(failure.isNotNull(), failed).otherwise(result(self.name, F.lit("completed"), findings, told, settings=settings, artifacts=artifacts))


def _six(value: Column) -> Column:
    return F.round(value, 6)


def default_registry(codec: imaging.Codec | None = dct.recoded) -> list[Analyzer]:
    """In the fixed order of reports; the face model is a plug-in."""
    return [Authenticity(), Unavailable("deepfake_detection", "no model checkpoint configured"), ImageForensics(codec)]


def analyse(media: DataFrame, registry: Sequence[Analyzer] | None = None) -> DataFrame:
    """media -> job_id, modules in registry order, status; one pass, one row a row.

    An analyzer that can't be planned, or reports another module's name or nothing for a row, yields a
    failed module there; the others' results stand.
    """
    media = media.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in PREPARED.items() if c not in media.columns])
    modules = []
    for no, analyzer in enumerate(default_registry() if registry is None else registry):
        column = f"_module_{no}"
        failed = lambda text, name=analyzer.name: result(name, F.lit("failed"), F.lit("{}"), F.array(F.lit(text)))
        try:
            ready = analyzer.prepare(media) if hasattr(analyzer, "prepare") else media
            found = ready.withColumn(column, analyzer.apply(ready).cast(MODULE))  # an unknown column or type shows here, not in a task
            media = found
            modules.append(F.when(F.col(column)["module"] == analyzer.name, F.col(column)).otherwise(failed("no result under this module's name")))
        except Exception as error:  # noqa: BLE001  one analyzer's failure is a result, not the job's end
            modules.append(failed(f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"))
    return media.select("job_id", F.array(*modules).alias("modules")).withColumn("status", jobs.status_of(F.col("modules")))


def artifacts(results: DataFrame) -> DataFrame:
    """results -> job_id, module, kind, name, content: what modules took out, as rows."""
    each = results.select("job_id", F.explode("modules").alias("m")).select("job_id", "m.module", F.explode("m.artifacts").alias("a"))
    return each.select("job_id", "module", "a.kind", "a.name", "a.content")
