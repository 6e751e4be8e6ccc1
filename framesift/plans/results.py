"""Registered queries over results: scored catalogues, evaluations and their files, origin assessments, case views.

What a query reads comes from the tables' texts, vectors and events.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoint import cut, shared_folder
from ..operators import analyzers, evaluate, forensics, imaging, rollups, video, views, watermark
from ..sources import media
from .catalogue import _JOBS_SQL, _jobs, _listed, _rounded, _seconds, _t, query
from .evidence import _grey_images, _levels_sql

# --- scored catalogues -----------------------------------------------------------------------------

#: What stands for a face model: a share of the image's upper half against its lower one.
_SLOPE, _SHIFT = 9.0, 0.25


def _upper_half(rgb: np.ndarray) -> np.ndarray | None:
    """The image as its own face; dark ones have none."""
    return rgb[..., 0] if rgb[..., 0].mean() >= 22 else None


def _model():  # noqa: ANN202
    def run(batch: list) -> list[float]:
        faces = [np.asarray(x, float) for x in batch]
        return [1 / (1 + np.exp(-(_SLOPE * (f[:32].sum() / f.sum()) - _SLOPE / 2 + _SHIFT))) for f in faces]

    return run


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as a catalogue of images, of which every label's files 7 are missing; the label is whether the first entry is positive."""
    images = _grey_images(spark, sf_dir).join(_t(spark, sf_dir, "embeddings").select("vec_id", "label", (F.get("embedding", F.lit(0)) > 0).cast("int").alias("positive")), "vec_id")
    path = F.concat(F.lit("set/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".png"))
    listed = images.select(F.col("vec_id").cast("string").alias("sample_id"), path.alias("path"), F.col("positive").alias("label"), F.col("label").alias("kind"), "image")
    return listed.drop("kind", "image"), listed.filter("kind <> 7").select("path", "image")


_CATALOG_SQL = f"""p AS (SELECT vec_id, label AS kind, CAST(embedding[1] > 0 AS INTEGER) AS label, i AS pos, least(255, floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 255)) AS v FROM embeddings, range(64) r(i)),
f AS (SELECT vec_id, any_value(kind) AS kind, any_value(label) AS label, avg(v) AS mean, sum(v) FILTER (pos < 32) / sum(v) AS upper FROM p GROUP BY vec_id),
c AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, 'set/' || kind || '/' || vec_id || '.png' AS path, label, CASE WHEN kind = 7 THEN 'read_error' WHEN mean < 22 THEN 'no_face' ELSE 'evaluated' END AS status,
  round(1 / (1 + exp(-({_SLOPE}::DOUBLE * upper - {_SLOPE / 2}::DOUBLE + {_SHIFT}::DOUBLE))), 8) AS s FROM f)"""


@query(f"""WITH {_CATALOG_SQL} SELECT sample_id, path, label, CASE WHEN status = 'evaluated' THEN s END AS score, CASE WHEN status = 'evaluated' THEN CAST(s >= 0.55 AS INTEGER) END AS prediction, status FROM c""")
def catalog_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue's images, cropped and scored by a model inside tasks."""
    return evaluate.scored_catalog(*_catalog(spark, sf_dir), _upper_half, _model, 0.55)


@query(f"""WITH {_CATALOG_SQL}, e AS (SELECT label, s AS score FROM c WHERE status = 'evaluated'),
n AS (SELECT count(*) FILTER (score >= 0.55 AND label = 1) AS tp, count(*) FILTER (score < 0.55 AND label = 0) AS tn, count(*) FILTER (score >= 0.55 AND label = 0) AS fp, count(*) FILTER (score < 0.55 AND label = 1) AS fn, avg((score - label) * (score - label)) AS brier_score FROM e)
SELECT (SELECT count(*) FROM c) AS samples, (SELECT count(*) FROM e) AS evaluated, (SELECT count(*) FROM c WHERE status = 'no_face') AS no_face, (SELECT count(*) FROM c WHERE status = 'read_error') AS read_errors, tp, tn, fp, fn,
round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(brier_score, 6) AS brier_score FROM n""")
def catalog_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _rounded(evaluate.catalog_metrics(evaluate.scored_catalog(*_catalog(spark, sf_dir), _upper_half, _model, 0.55), 0.55))
    return told.select("samples", "evaluated", "no_face", "read_errors", "tp", "tn", "fp", "fn", "accuracy", "precision", "recall", "brier_score")


@query(f"""WITH {_CATALOG_SQL} SELECT sample_id, path, label, CASE WHEN status = 'evaluated' THEN s END AS score, status, NULL AS actual, NULL AS real, NULL AS fake FROM c
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, CASE label WHEN 0 THEN 'real' ELSE 'fake' END, count(*) FILTER (s < 0.55), count(*) FILTER (s >= 0.55) FROM c WHERE status = 'evaluated' GROUP BY label""")
def evaluation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation's files, predictions and the matrix, written and read back."""
    at = shared_folder(spark, "evaluation")
    rows = cut(evaluate.scored_catalog(*_catalog(spark, sf_dir), _upper_half, _model, 0.55))  # its files read these, none runs the model again
    media.write_evaluation(rows, evaluate.catalog_metrics(rows, 0.55), at)
    read = spark.read.option("header", True).schema("sample_id string, path string, label int, score double, prediction int, status string").csv(f"{at}/predictions")
    matrix = spark.read.option("header", True).schema("actual string, real long, fake long").csv(f"{at}/confusion_matrix")
    return read.drop("prediction").unionByName(matrix, allowMissingColumns=True)


@query(f"""WITH {_levels_sql(90)}, s AS (SELECT vec_id, max(e) AS most, round(quantile_cont(e, 0.95), 4) AS p95, round(avg(CASE WHEN e >= 20 THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(e), 4) AS mean FROM e GROUP BY vec_id),
k AS (SELECT * FROM s WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), z AS (SELECT s.*, k.p95 AS k95, k.share AS ks, k.mean AS km FROM s, k WHERE s.vec_id <> k.vec_id)
SELECT CAST((SELECT vec_id FROM k) AS VARCHAR) AS edited_id, any_value(km) AS edited_mean_error, count(*) AS benign_case_count, count(*) FILTER (share > 0) AS with_highlights, count(*) FILTER (share >= ks) AS meeting_ratio, count(*) FILTER (p95 >= k95) AS meeting_p95,
arg_min(CAST(vec_id AS VARCHAR), (-p95, CAST(vec_id AS VARCHAR))) AS strongest, max(p95) AS strongest_p95 FROM z""")
def recompressed_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors' images as cases, the least of them the one known edit, evaluated from files of their bytes."""
    grey = _grey_images(spark, sf_dir).select(F.concat(F.col("vec_id").cast("string"), F.lit(".png")).alias("file"), F.col("vec_id").cast("string").alias("id"), "vec_id", "image")
    least = _t(spark, sf_dir, "embeddings").agg(F.min("vec_id").alias("least"))
    files = grey.select("file", F.col("image.data").alias("content"))
    known = F.col("vec_id") == F.col("least")
    cases = grey.crossJoin(F.broadcast(least)).select("id", "file", known.alias("known_edit"), F.when(known, F.array(*map(F.lit, (2, 2, 6, 6)))).alias("known_edit_region_xyxy"), F.sha2("image.data", 256).alias("image_sha256"))  # one row
    told = evaluate.recompressed_summary(evaluate.recompressed_cases(cases, files, grey.select(F.col("file").alias("path"), "image")), listed=False)
    return told.select(
        "edited_id", "edited_mean_error", "benign_case_count", F.col("benign_with_highlighted_pixels").alias("with_highlights"), F.col("benign_meeting_edited_ratio").alias("meeting_ratio"), F.col("benign_meeting_edited_p95").alias("meeting_p95"),
        F.col("strongest_benign_by_p95.id").alias("strongest"), F.col("strongest_benign_by_p95.value").alias("strongest_p95"),
    )


# --- origin ----------------------------------------------------------------------------------------

_CLAIMED = ("", "trainedAlgorithmicMedia", "c2pa", "Midjourney", "Created by Google Generative AI")


@query(f"""WITH t AS (SELECT doc_id, ascii(text) % 3 = 0 AS mark, text, lower(text || ' ' || ({list(_CLAIMED)})[ascii(substr(text, 2, 1)) % 5 + 1]) AS low FROM documents),
f AS (SELECT doc_id, mark, {_listed(forensics.AI_CLAIMS)} AS claims, {_listed(forensics.PROVIDERS)} AS providers FROM t)
SELECT doc_id, CASE WHEN mark THEN 'strong_ai_origin_evidence' WHEN claims <> '' THEN 'unverified_ai_origin_claim' ELSE 'inconclusive' END AS assessment, claims, providers,
CAST(mark AS BIGINT) + CAST(NOT mark AND claims = '' AS BIGINT) + CAST(claims <> '' AS BIGINT) + CAST(claims = '' AND providers <> '' AS BIGINT) AS warnings FROM f""")
def origin_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authenticity module over texts as files, with a visible mark on some; claims stand at the texts' ends."""
    text = F.concat("text", F.lit(" "), F.get(F.array(*map(F.lit, _CLAIMED)), F.ascii(F.substring("text", 2, 1)) % 5))
    mark = F.struct((F.ascii("text") % 3 == 0).alias("found"), F.lit(0.9).alias("score"), F.lit("bottom_right").alias("location"), F.lit(None).cast("struct<x:int,y:int,w:int,h:int>").alias("box"), F.lit(3).alias("frames")).cast(watermark.RESULT)
    given = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.lit("video/mp4").alias("media_type"), F.encode(text, "UTF-8").alias("content"), mark.alias("watermark"))
    told = analyzers.analyse(given, [analyzers.Authenticity()]).select("job_id", F.get("modules", F.lit(0)).alias("m"))
    found = F.from_json("m.findings", "struct<assessment:string,provenance:struct<ai_claims:array<string>,providers:array<string>>>")
    return told.select("job_id", "m", found.alias("f")).select(F.col("job_id").alias("doc_id"), "f.assessment", F.array_join("f.provenance.ai_claims", ",").alias("claims"), F.array_join("f.provenance.providers", ",").alias("providers"), F.size("m.warnings").cast("long").alias("warnings"))


# --- case views ------------------------------------------------------------------------------------


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as results: what they show follows from the text's letters and length."""
    a, b, n = F.ascii("text"), F.ascii(F.substring("text", 2, 1)), F.length("text")
    assessment = F.get(F.array(F.lit("strong_ai_origin_evidence"), F.lit("unverified_ai_origin_claim"), F.lit("inconclusive"), F.lit(None).cast("string")), a % 4)
    probability = F.when(b % 3 > 0, n % 1000 / 1000.0)
    model = F.struct(F.lit("deepfake_detection").alias("module"), F.when(b % 3 > 0, "completed").otherwise("skipped").alias("status"))
    return _t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("job_id"), F.when(n % 2 == 0, "partially_completed").otherwise("completed").alias("status"), F.when(n % 5 == 0, "video/mp4").otherwise("image/png").alias("media_type"), assessment.alias("assessment"), probability.alias("probability"),
        F.when(b % 3 > 0, n % 7).cast("long").alias("analysed_faces"), F.when(n % 5 > 0, a % 2 == 0).alias("lsb_detected"), F.when(n % 5 > 0, n % 256).cast("long").alias("ela_max"), F.array(model).alias("modules"),
    )


_CASES_SQL = """c AS (SELECT doc_id AS job_id, CASE WHEN n % 2 = 0 THEN 'partially completed' ELSE 'completed' END AS state, n % 5 = 0 AS film, ['strong_ai_origin_evidence', 'unverified_ai_origin_claim', 'inconclusive', NULL][a % 4 + 1] AS assessment,
CASE WHEN b % 3 > 0 THEN n % 1000 / 1000.0::DOUBLE END AS probability, CASE WHEN b % 3 > 0 THEN n % 7 END AS faces, CASE WHEN n % 5 > 0 THEN a % 2 = 0 END AS lsb, CASE WHEN n % 5 > 0 THEN n % 256 END AS ela
FROM (SELECT doc_id, ascii(text) AS a, ascii(substr(text, 2, 1)) AS b, length(text) AS n FROM documents))"""


@query(f"""WITH {_CASES_SQL} SELECT job_id, CASE WHEN assessment = 'strong_ai_origin_evidence' THEN 'Strong AI-origin evidence' WHEN assessment = 'unverified_ai_origin_claim' THEN 'Unverified AI-origin claim' WHEN probability IS NOT NULL THEN 'Model score ' || printf('%.1f%%', probability * 100) ELSE 'Inconclusive' END AS headline,
CASE WHEN assessment = 'strong_ai_origin_evidence' THEN 'origin' WHEN assessment = 'unverified_ai_origin_claim' THEN 'claim' WHEN probability IS NOT NULL THEN 'score' ELSE 'none' END AS badge, state, CASE WHEN film THEN 'video' ELSE 'image' END AS media,
coalesce(CAST(faces AS VARCHAR), '—') AS faces, CASE WHEN lsb THEN 'payload found' WHEN NOT lsb THEN 'no payload' ELSE 'not applied' END AS low_bits FROM c""")
def case_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.summary(_cases(spark, sf_dir))


@query(f"""WITH {_CASES_SQL} SELECT job_id, 'model' AS signal, CASE WHEN probability IS NULL THEN 'not evaluated' ELSE printf('%.1f%%', probability * 100) END AS value FROM c
UNION ALL SELECT job_id, 'origin', coalesce(replace(assessment, '_', ' '), 'not evaluated') FROM c UNION ALL SELECT job_id, 'ela', coalesce('max ' || ela, 'not applied') FROM c
UNION ALL SELECT job_id, 'lsb', CASE WHEN lsb THEN 'payload found' WHEN NOT lsb THEN 'no payload' ELSE 'not applied' END FROM c""")
def signal_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.signal_cards(_cases(spark, sf_dir))


@query("""SELECT user_id AS job_id, event_id AS frame_index, printf('%.2f', event_id / 7) AS "at", CASE WHEN event_type = 'error' THEN '—' ELSE printf('%.1f%%', least(value / 307, 1) * 100) END AS score FROM events""")
def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their times, and scores where there is one."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("frame_index"), (F.col("event_id") / 7).alias("timestamp_seconds"), F.when(F.col("event_type") != "error", F.least(F.col("value") / 307, F.lit(1.0))).alias("probability"))
    return views.frame_table(e)


@query(f"""WITH r AS (SELECT * FROM {_JOBS_SQL} ORDER BY created_at DESC, id DESC LIMIT 60), f AS (SELECT * FROM r WHERE (contains(lower(source_name), '1') OR contains(lower(id), '1')) AND status <> 'failed' AND status = 'completed')
SELECT id, source_name, status, epoch_us(created_at) AS created_at, (SELECT count(*) FROM r) AS fetched, (SELECT count(*) FROM f) AS shown FROM f""")
def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.history(_jobs(spark, sf_dir), " 1", "completed", 60).select("id", "source_name", "status", _seconds("created_at"), "fetched", "shown")


@query("""WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS first, length(text) AS n, ascii(text) % 3 AS k FROM documents)
SELECT doc_id, CASE WHEN k = 0 THEN 'no checkpoint · ' || left(first, 20) ELSE 'first line: ' || first || ' · length: ' || n || ' · long: ' || CASE WHEN n > 1000 THEN 'true' ELSE 'false' END END AS detail, CASE WHEN k = 0 THEN 'skipped' ELSE 'completed' END AS status FROM t""")
def module_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar findings of a module, texts among them that look like JSON, or its warnings."""
    first, n, skipped = F.get(F.split("text", "\n"), F.lit(0)), F.length("text"), F.ascii("text") % 3 == 0
    body = F.to_json(F.struct(first.alias("first_line"), n.alias("length"), (n > 1000).alias("long"), F.lit("left out").alias("assessment"), F.array(F.lit(1)).alias("list")))
    warnings = F.when(skipped, F.array(F.lit("no checkpoint"), F.substring(first, 1, 20))).otherwise(F.array().cast("array<string>"))
    module = F.struct(F.lit("m").alias("module"), F.when(skipped, "skipped").otherwise("completed").alias("status"), body.alias("findings"), warnings.alias("warnings"))
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.array(module).alias("modules"))
    return views.module_rows(rows).select(F.col("job_id").alias("doc_id"), "status", "detail")


@query("""WITH d AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^[a-z]+:/+', '/') ELSE url END AS path, url FROM pages)
SELECT page_id, CASE WHEN octet_length(encode(html)) % 4 > 0 THEN octet_length(encode(html)) END AS size FROM pages""")
def image_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses as paths of media and of decoded files, with and without their scheme."""
    pages = _t(spark, sf_dir, "pages").withColumn("url", F.concat_ws("/", "url", F.col("page_id").cast("string")))
    size = F.octet_length(F.encode("html", "UTF-8"))
    image = F.struct(F.lit(1).alias("height"), size.alias("width"), F.lit(1).alias("channels"), F.encode("html", "UTF-8").alias("data")).cast(imaging.IMAGE)
    decoded = pages.filter(size % 4 > 0).select("url", image.alias("image")).withColumnRenamed("url", "path")
    plain = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^[a-z]+:/+", "/")).otherwise(F.col("url"))
    joined = media.with_images(pages.select("page_id", plain.alias("path")), decoded)
    return joined.select("page_id", F.col("image.width").cast("long").alias("size"))


# --- kernels ---------------------------------------------------------------------------------------

_KERNEL = np.array([[0.5, -1.0, 0.25], [2.0, 9.0, 1.0], [-0.75, 0.5, 1.5]])
_WEIGHTS = [(y - 1, x - 1, -1.0 if (y, x) == (1, 1) else float(_KERNEL[y, x] / (_KERNEL.sum() - _KERNEL[1, 1]))) for y in range(3) for x in range(3)]
_GREY_SQL = "SELECT vec_id, i // 8 AS y, i % 8 AS x, least(255, floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 255)) / 255 AS v FROM embeddings, range(64) r(i)"


@query(f"""WITH p AS ({_GREY_SQL}), k(dy, dx, w) AS (VALUES {", ".join(f"({y}, {x}, {w!r}::DOUBLE)" for y, x, w in _WEIGHTS)}),
c AS (SELECT vec_id, p.y - dy AS y, p.x - dx AS x, sum(v * w) AS s FROM p, k WHERE p.y - dy BETWEEN 0 AND 7 AND p.x - dx BETWEEN 0 AND 7 GROUP BY ALL)
SELECT vec_id, round(sum(abs(s)) / 64, 6) AS level FROM c GROUP BY vec_id""")
def prediction_error_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error of each pixel's prediction from its neighbours by a constrained kernel."""
    levels = _grey_images(spark, sf_dir).select("vec_id", imaging.prediction_errors(F.col("image"), _KERNEL[None])["levels"].alias("l"))
    return levels.select("vec_id", F.round(F.get("l", F.lit(0)), 6).alias("level"))


@query("""WITH c AS (SELECT doc_id, text, lang, source, ascii(substr(text, 3, 1)) % 4 AS k FROM documents)
SELECT doc_id, 1 + length(text) % 4000 AS width, CASE WHEN k > 0 THEN left(regexp_replace(lang || ':' || source, '[^ -~]', '', 'g'), 40) END AS description, CASE WHEN k > 1 THEN CAST(length(text) % 8 + 1 AS VARCHAR) END AS orientation FROM c""")
def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of PNG heads: a text that lies beside the directory, and a number inside it."""
    from ..operators import headers
    from .evidence import _number

    n, k = F.length("text"), F.ascii(F.substring("text", 3, 1)) % 4
    words = F.substring(F.regexp_replace(F.concat("lang", F.lit(":"), "source"), "[^ -~]", ""), 1, 40)
    body = F.concat(F.hex(F.encode(words, "US-ASCII")), F.lit("00"))
    entry = lambda tag, kind_, count, value: F.concat(F.lit(f"{tag:04X}{kind_:04X}"), _number(count), value)
    places = F.when(k > 1, F.lit(8 + 2 + 24 + 4)).otherwise(F.lit(8 + 2 + 12 + 4)).cast("long")
    described = entry(270, 2, (F.length(body) / 2).cast("long"), F.when(F.length(body) <= 8, F.rpad(body, 8, "0")).otherwise(_number(places)))
    oriented = entry(274, 3, F.lit(1).cast("long"), F.concat(F.lpad(F.hex((n % 8 + 1).cast("long")), 4, "0"), F.lit("0000")))
    tiff = F.concat(F.lit("4D4D002A00000008"), F.when(k > 1, F.concat(F.lit("0002"), described, oriented)).otherwise(F.concat(F.lit("0001"), described)), F.lit("00000000"), body)
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _number((1 + n % 4000).cast("long")), _number(5), F.lit("0802000000"), F.lit("00000000"))
    exif = F.when(k > 0, F.concat(_number((F.length(tiff) / 2).cast("long")), F.lit(b"eXIf".hex()), tiff, F.lit("00000000"))).otherwise("")
    files = _t(spark, sf_dir, "documents").select("doc_id", F.unhex(F.concat(head, exif)).alias("content"), F.lit("image/png").alias("media_type"))
    found = headers.inspected(files)
    tag = lambda name: F.element_at("header.exif", name)
    return found.select("doc_id", F.col("header.width").cast("long").alias("width"), tag("ImageDescription").alias("description"), tag("Orientation").alias("orientation"))


# --- files of a catalogue and a study ----------------------------------------------------------------


@query("""SELECT CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 9 THEN 'test' ELSE 'validation' END AS split, 's' || vec_id AS sample_id, 'p' || label || ';q' || vec_id AS identity_ids, CAST(embedding[1] > 0 AS INTEGER) AS label FROM embeddings""")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits written as files, most rows in one of them, and read back with the split from the folder."""
    at, k = shared_folder(spark, "splits"), F.col("vec_id") % 10
    split: Column = F.when(k < 7, "train").when(k < 9, "test").otherwise("validation")
    people = F.array(F.concat(F.lit("p"), F.col("label").cast("string")), F.concat(F.lit("q"), F.col("vec_id").cast("string")))
    records = _t(spark, sf_dir, "embeddings").select(split.alias("split"), F.concat(F.lit("s"), "vec_id").alias("sample_id"), people.alias("identity_ids"), (F.get("embedding", F.lit(0)) > 0).cast("int").alias("label"), F.col("label").cast("string").alias("source_group"))
    media.write_splits(records, at)
    return spark.read.option("header", True).schema("sample_id string, identity_ids string, label int, source_group string, split string").csv(f"{at}/splits").select("split", "sample_id", "identity_ids", "label")


@query("""WITH d AS (SELECT doc_id, ascii(text) % 4 AS k, split_part(text, chr(10), 1) AS first FROM documents)
SELECT 'd' || doc_id AS path, CASE k WHEN 0 THEN '' WHEN 1 THEN 'document lacks: task' WHEN 2 THEN 'schema_version must be 1|participant ids must differ' ELSE 'not a JSON object' END AS first_errors FROM d""")
def study_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies as JSON, whole, without a key, with a version and ids that are wrong, or cut short."""
    k, first = F.ascii("text") % 4, F.get(F.split("text", "\n"), F.lit(0))
    person = F.struct(F.lit("P1").alias("id"), F.create_map(F.lit("upload"), F.lit("success")).alias("tasks"), F.create_map(F.lit("upload_ease"), F.lit(3)).alias("ratings"), first.alias("most_confusing"), F.lit("").alias("recommended_change"))
    people = F.when(k == 2, F.array(person, person)).otherwise(F.array(person))
    whole = F.to_json(F.struct(F.when(k == 2, 2).otherwise(1).alias("schema_version"), F.when(k != 1, first).alias("task"), people.alias("participants")))
    text = F.when(k == 3, F.substr(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole)
    told = rollups.study_document_errors(_t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), text.alias("text")))
    return told.select("path", F.when(F.array_contains("errors", "not a JSON object"), "not a JSON object").otherwise(F.array_join("errors", "|")).alias("first_errors"))
