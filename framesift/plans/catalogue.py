"""All registered queries of the media operators over the driver's tables, with the SQL that says the same.

The tables stand in for media: documents' bytes for files, events for one video per user, embeddings
for pixel residuals, orders for the job ledger, conversations for study answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels, scalar
from ..functions.checkpoint import shared_folder
from ..operators import analyzers, catalog, evaluate, forensics, headers, imaging, ingest, jobs, metrics, process, report, rollups, sampling, scoring, watermark
from ..sources import media
from ..streaming import ingest as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(*columns: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in columns]


# --- ingestion -------------------------------------------------------------------------------------

_HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "000000186674797069736F6D", "00000014667479707174202000000000", "")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content"))


_FILES_SQL = f"""SELECT doc_id, unhex(([{", ".join(f"'{h}'" for h in _HEADS)}])[doc_id % 5 + 1]) || encode(text) AS content FROM documents"""
_TYPE_SQL = """CASE doc_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'video/mp4' WHEN 3 THEN 'video/quicktime' END"""


@query(f"""WITH f AS ({_FILES_SQL}), g AS (SELECT doc_id, {_TYPE_SQL} AS media_type, sha256(content) AS sha256, CAST(octet_length(content) AS BIGINT) AS size_bytes FROM f)
SELECT *, CASE WHEN size_bytes = 0 THEN 'empty' WHEN size_bytes > 5000 THEN 'too_large' WHEN media_type IS NULL THEN 'unsupported_type' END AS reject_reason FROM g""")
def ingest_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(_files(spark, sf_dir), most=5000).drop("content")


@query("""SELECT page_id, CASE WHEN n IN ('', '.', '..') THEN 'unnamed' ELSE n END AS name FROM
(SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS n FROM pages)""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", ingest.safe_name(F.col("url")).alias("name"))


@query("""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\\.\\.?/', '', 'g') AS base FROM pages),
p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN base WHEN 1 THEN 'a/../../' || base WHEN 2 THEN '/' || base ELSE 'a/../' || base END || CASE WHEN page_id % 3 = 0 THEN '.PNG' ELSE '.gif' END AS path FROM b),
s AS (SELECT page_id, path, list_transform(string_split(path, '/'), lambda x: CASE x WHEN '..' THEN -1 WHEN '.' THEN 0 WHEN '' THEN 0 ELSE 1 END) AS steps FROM p)
SELECT page_id, path[1] <> '/' AND path[1] <> chr(92) AND NOT regexp_matches(path, '^[A-Za-z]:') AND list_min([list_sum(steps[1:i]) FOR i IN range(1, len(steps) + 1)]) >= 0 AS inside,
regexp_matches(lower(path), '\\.(jpg|jpeg|png)$') AS image FROM s""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    base = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"\.\.?/", "")
    tail = F.when(F.col("page_id") % 3 == 0, ".PNG").otherwise(".gif")
    kind = F.col("page_id") % 4
    path = F.when(kind == 0, base).when(kind == 1, F.concat(F.lit("a/../../"), base)).when(kind == 2, F.concat(F.lit("/"), base)).otherwise(F.concat(F.lit("a/../"), base))
    paths = pages.select("page_id", F.concat(path, tail).alias("path"))
    return paths.select("page_id", ingest.stays_inside(F.col("path")).alias("inside"), ingest.image_suffix(F.col("path")).alias("image"))


@query("""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN sha256('altered') ELSE sha256(text) END AS sha FROM documents), f AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 11 <> 3)
SELECT e.doc_id, CASE WHEN f.sha IS NULL THEN 'read_error' WHEN f.sha = e.sha THEN 'ok' ELSE 'differs' END AS status FROM e LEFT JOIN f USING (doc_id)""")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    wanted = F.when(F.col("doc_id") % 10 == 0, F.sha2(F.lit(b"altered"), 256)).otherwise(F.sha2("content", 256))
    return ingest.verify_hashes(docs.select("doc_id", wanted.alias("sha256")), docs.filter("doc_id % 11 <> 3"), key="doc_id").select("doc_id", "status")


@query("""SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_line FROM documents""")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return catalog.first_of(docs, "sha256", "doc_id").select("doc_id", "sha256", "first_line")


@query("""SELECT doc_id, octet_length(encode(text)) % 3000 * 1000 <= 1500000 AS within_limit, (doc_id % 40) > 0 AND doc_id % 7 > 0 AS sound,
(doc_id % 100) * 60 / 25.0 > 120 AS too_long FROM documents""")
def media_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    fps = F.when(F.col("doc_id") % 40 > 0, F.lit(25.0)).otherwise(F.lit(float("nan")))
    return d.select(
        "doc_id", ingest.within_pixels(F.octet_length("text") % 3000, F.lit(1000), 1_500_000).alias("within_limit"),
        ingest.sound_header(fps, F.col("doc_id") % 7, F.lit(10), F.lit(10)).alias("sound"),
        sampling.too_long((F.col("doc_id") % 100) * 60, F.lit(25.0), 120).alias("too_long"),
    )


@query("""WITH d AS (SELECT doc_id, (['image/png', 'image/gif', '', 'video/mp4'])[doc_id % 4 + 1] AS mime, 'a' || doc_id || (['.JPG', '.txt', '.mov', '.gif', '.jpeg'])[doc_id % 5 + 1] AS name, n_chars * 100000 AS size FROM documents)
SELECT doc_id, (mime IN ('image/jpeg', 'image/png', 'video/mp4', 'video/quicktime') OR regexp_matches(lower(name), '\\.(jpg|jpeg|png|mp4|mov)$')) AND size <= 524288000 AS accepted,
doc_id || CASE mime WHEN 'image/png' THEN '.png' WHEN 'video/mp4' THEN '.mp4' END AS stored FROM d""")
def client_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    mime, end = F.element_at(F.array(*map(F.lit, ("image/png", "image/gif", "", "video/mp4"))), (k % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, (".JPG", ".txt", ".mov", ".gif", ".jpeg"))), (k % 5 + 1).cast("int"))
    d = _t(spark, sf_dir, "documents").select("doc_id", mime.alias("mime"), F.concat(F.lit("a"), k.cast("string"), end).alias("name"), (F.col("n_chars") * 100000).alias("size"))
    return d.select("doc_id", ingest.accepted_by_client(F.col("mime"), F.col("name"), F.col("size")).alias("accepted"), ingest.stored_name(k.cast("string"), F.col("mime")).alias("stored"))


# --- job ledger ------------------------------------------------------------------------------------

_JOBS_SQL = """(SELECT CAST(o_orderkey AS VARCHAR) AS id,
 CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'queued' WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 1 THEN 'processing'
      WHEN o_orderkey % 5 = 2 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'partially_completed' ELSE 'completed' END AS status,
 'Clip-' || o_custkey || '.MOV' AS source_name, o_orderdate + to_milliseconds(o_orderkey) AS created_at,
 o_orderdate + to_milliseconds(o_orderkey) + to_hours(o_custkey) AS updated_at,
 CASE WHEN o_orderkey % 5 = 2 THEN 'decode error' END AS error, CASE WHEN o_orderkey % 5 > 2 THEN 'r' || o_orderkey END AS result, o_custkey, o_orderkey FROM orders)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    five, state = F.col("o_orderkey") % 5, F.col("o_orderstatus")
    status = (
        F.when((state == "O") & (five == 0), "queued").when((state == "O") & (five == 1), "processing").when(five == 2, "failed")
        .when(state == "P", "partially_completed").otherwise("completed")
    )
    created = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 1000)
    updated = F.timestamp_micros(F.unix_micros(created) + F.col("o_custkey") * 3_600_000_000)
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), status.alias("status"), F.concat(F.lit("Clip-"), "o_custkey", F.lit(".MOV")).alias("source_name"),
        created.alias("created_at"), updated.alias("updated_at"), F.when(five == 2, "decode error").alias("error"),
        F.when(five > 2, F.concat(F.lit("r"), "o_orderkey")).alias("result"), "o_custkey", "o_orderkey",
    )


def _seconds(c: str) -> F.Column:
    return F.unix_micros(c).alias(c)


_STAMPS = "epoch_us(created_at) AS created_at, epoch_us(updated_at) AS updated_at"


@query(f"SELECT id, status, source_name, {_STAMPS} FROM {_JOBS_SQL} WHERE id = '7'")
def job_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.get(_jobs(spark, sf_dir), "7").select("id", "status", "source_name", _seconds("created_at"), _seconds("updated_at"))


@query(f"SELECT id, status, epoch_us(created_at) AS created_at FROM {_JOBS_SQL} ORDER BY created_at DESC, id DESC LIMIT 50")
def job_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = jobs.recent(_jobs(spark, sf_dir))
    return picked.select("id", "status", _seconds("created_at"))


@query(f"SELECT id, status, epoch_us(updated_at) AS updated_at FROM {_JOBS_SQL} WHERE updated_at < TIMESTAMP '1996-01-01' AND status NOT IN ('queued', 'processing')")
def job_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = jobs.expired(_jobs(spark, sf_dir), F.lit("1996-01-01").cast("timestamp"))
    return due.select("id", "status", _seconds("updated_at"))


@query(f"""SELECT id, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'late' END ELSE error END AS error,
CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 6 = 0 THEN 'new' ELSE result END AS result FROM {_JOBS_SQL}""")
def job_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    k = F.col("o_orderkey")
    changes = j.filter(k % 3 == 0).select("id", F.lit("failed").alias("status"), "updated_at", F.when(k % 2 == 0, "late").alias("error"), F.when(k % 6 == 0, "new").alias("result"))
    return jobs.update(j, changes).select("id", "status", "error", "result")


@query(f"SELECT id, status FROM {_JOBS_SQL} WHERE NOT (updated_at < TIMESTAMP '1996-01-01' AND status NOT IN ('queued', 'processing'))")
def job_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    return jobs.delete(j, j.filter(jobs.expired_at(F.lit("1996-01-01").cast("timestamp")))).select("id", "status")


@query(f"""SELECT id, source_name, status FROM (SELECT * FROM {_JOBS_SQL} ORDER BY created_at DESC, id DESC LIMIT 100) WHERE (contains(lower(source_name), 'clip-1') OR contains(lower(id), 'clip-1')) AND status = 'completed'""")
def job_history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.search(_jobs(spark, sf_dir), " CLIP-1 ", "completed").select("id", "source_name", "status")


@query(f"SELECT status, count(*) AS n FROM {_JOBS_SQL} GROUP BY status")
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""SELECT count(*) AS expired, count(*) FILTER (o_custkey % 10 <> 0) AS deleted, count(*) FILTER (o_custkey % 10 = 0) AS failed,
sha256(coalesce(string_agg(id, ',' ORDER BY id) FILTER (o_custkey % 10 <> 0), '')) AS deleted_ids FROM {_JOBS_SQL} WHERE updated_at < TIMESTAMP '1996-06-01' AND status NOT IN ('queued', 'processing')""")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("o_custkey") % 10 == 0, "../").otherwise("uploads/"), "id")
    plan = jobs.retention_plan(_jobs(spark, sf_dir), F.lit("1996-06-01").cast("timestamp"), ingest.stays_inside(path))
    return jobs.retention_counts(plan).crossJoin(jobs.ids_sha256(plan.filter("safe").select("id")).withColumnRenamed("sha256", "deleted_ids"))


@query(f"""WITH l AS (SELECT id, unnest([{{'n': 0, 's': 'Forensic Risk Assessment'}}, {{'n': 1, 's': 'Analysis ID: ' || id}}, {{'n': 2, 's': 'Status: ' || status}}, {{'n': 3, 's': 'Source: ' || source_name}},
{{'n': 4, 's': 'Media type: video/quicktime'}}, {{'n': 5, 's': 'SHA-256: ' || sha256(id)}}, {{'n': 6, 's': 'Size: ' || o_custkey || ' bytes'}}, {{'n': 7, 's': 'Created: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g')}}]) AS u FROM {_JOBS_SQL})
SELECT id, CAST(u.n AS BIGINT) AS line_no, u.s AS line FROM l""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir).select("id", "status", "source_name", F.lit("video/quicktime").alias("media_type"), F.sha2(F.col("id").cast("binary"), 256).alias("sha256"), F.col("o_custkey").alias("size_bytes"), "created_at")
    return report.report_lines(j).select("id", *_long("line_no"), "line")


# --- frames and scores -----------------------------------------------------------------------------

_VIDEOS_SQL = "(SELECT user_id, count(*) AS total, CAST(10 + user_id % 20 AS DOUBLE) AS fps FROM events GROUP BY user_id)"


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total")).withColumn("fps", (10 + F.col("user_id") % 20).cast("double"))


def _sampled_sql(interval: float, most: int) -> str:
    return f"""WITH v AS (SELECT *, greatest(1.0, fps * {interval}) AS step FROM {_VIDEOS_SQL}), c AS (SELECT *, CAST(ceil(total / step) AS BIGINT) AS asked FROM v),
r AS (SELECT *, least(asked, {most}) AS k, asked > {most} AS capped FROM c), e AS (SELECT *, unnest(range(k)) AS ordinal FROM r),
i AS (SELECT *, CAST(CASE WHEN capped AND k > 1 THEN round_even(ordinal * (total - 1) / (k - 1), 0) ELSE least(round_even(ordinal * step, 0), total - 1) END AS BIGINT) AS frame_index FROM e)
SELECT user_id, ordinal, frame_index, capped, round(frame_index / fps, 6) AS timestamp_seconds FROM i"""


def _sampled(spark: SparkSession, sf_dir: str, interval: float, most: int) -> DataFrame:
    rows = sampling.sampled_frames(_videos(spark, sf_dir), interval_seconds=interval, most=most)
    return rows.select("user_id", "ordinal", "frame_index", "capped", F.round("timestamp_seconds", 6).alias("timestamp_seconds"))


@query(_sampled_sql(0.5, 300))
def frame_sampling_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir, 0.5, 300)


@query(_sampled_sql(0.1, 7))
def frame_sampling_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir, 0.1, 7)


@query("""WITH v AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), k AS (SELECT *, least(n, 12) AS k FROM v)
SELECT user_id, CASE WHEN k = 1 THEN [0] ELSE list_transform(range(k), lambda i: CAST(floor(i * (n - 1) / (k - 1)) AS BIGINT)) END::VARCHAR AS indices FROM k""")
def watermark_frame_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _videos(spark, sf_dir)
    return v.select("user_id", F.concat(F.lit("["), F.array_join(sampling.even_indices(F.col("total")), ", "), F.lit("]")).alias("indices"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, frame_index FROM f WHERE frame_index IN (0, n // 2, n - 1)""")
def frame_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    wanted = _videos(spark, sf_dir).select("user_id", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.expr("total div 2"), F.col("total") - 1))).alias("frame_index"))
    return sampling.numbered(e, "user_id", "at").join(wanted, ["user_id", "frame_index"]).select("user_id", "event_id", "frame_index")


@query("""WITH s AS (SELECT user_id, least(greatest(value / 300, 0), 1) AS v FROM events), w AS (SELECT *, exp((v - max(v) OVER (PARTITION BY user_id)) / 0.1) AS w FROM s)
SELECT user_id, round(sum(v * w) / sum(w), 6) AS video_score FROM w GROUP BY user_id""")
def video_softmax_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", (F.col("value") / 300).alias("score"))
    return scoring.video_scores(e, "user_id", "score").select("user_id", F.round("video_score", 6).alias("video_score"))


@query("""SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def video_top_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_frame(_t(spark, sf_dir, "events"), "user_id", "value", "event_id")


@query("""WITH c AS (SELECT user_id, count(*) AS candidates, count(*) FILTER (event_type <> 'error') AS faces, least(avg(value) / 200, 1) AS score FROM events GROUP BY user_id)
SELECT user_id, candidates, faces, round(faces / candidates, 6) AS face_coverage, CASE WHEN score >= 0.5 THEN 'suspicious' ELSE 'lower_risk' END AS decision,
list_filter([CASE WHEN faces < candidates THEN 'some frames without a face' END, CASE WHEN faces = 0 THEN 'no face' END], lambda x: x IS NOT NULL)::VARCHAR AS warnings FROM c""")
def face_coverage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("event_type") != "error").alias("faces"), F.least(F.avg("value") / 200, F.lit(1.0)).alias("score"))
    faces, all_ = F.col("faces"), F.col("candidates")
    told = F.array_compact(F.array(F.when(faces < all_, "some frames without a face"), F.when(faces == 0, "no face")))
    return c.select("user_id", "candidates", "faces", F.round(scoring.coverage(faces, all_), 6).alias("face_coverage"), scoring.decision(F.col("score"), 0.5, True).alias("decision"), F.concat(F.lit("["), F.array_join(told, ", "), F.lit("]")).alias("warnings"))


@query("SELECT event_id, round(1 / (1 + exp(-((value - 100) / 50) / 1.4788347482681274)), 6) AS probability FROM events")
def calibrated_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.round(scoring.calibrated((F.col("value") - 100) / 50, 1.4788347482681274), 6).alias("probability"))


@query("SELECT event_id, 'skipped' AS status, CAST(NULL AS DOUBLE) AS probability FROM events")
def model_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.predict(_t(spark, sf_dir, "events"), None, features="value").select("event_id", "status", "probability")


# --- bytes -----------------------------------------------------------------------------------------

_BYTE_ROWS = "(SELECT doc_id, unnest(range(octet_length(encode(text)))) AS pos, unnest(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS INTEGER))) AS v FROM documents)"


def _bytes(spark: SparkSession, sf_dir: str, channels: int = 3) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return forensics.histograms(docs, "doc_id", "content", channels)


@query(f"SELECT doc_id, CAST(pos % 3 AS BIGINT) AS channel, round(avg(v & 1), 9) AS ones_ratio FROM {_BYTE_ROWS} GROUP BY ALL")
def lsb_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.channel_statistics(_bytes(spark, sf_dir), "doc_id").select("doc_id", *_long("channel"), F.round("ones_ratio", 9).alias("ones_ratio"))


@query(f"""WITH p AS (SELECT doc_id, pos % 3 AS channel, v >> 1 AS pair, count(*) AS n, sum(v & 1) AS ones FROM {_BYTE_ROWS} GROUP BY ALL)
SELECT doc_id, CAST(channel AS BIGINT) AS channel, round(avg(abs(n - 2 * ones) / n), 9) AS pair_imbalance FROM p GROUP BY ALL""")
def lsb_pair_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.channel_statistics(_bytes(spark, sf_dir), "doc_id").select("doc_id", *_long("channel"), F.round("pair_imbalance", 9).alias("pair_imbalance"))


@query(f"SELECT doc_id, round(entropy(v), 9) AS entropy FROM {_BYTE_ROWS} GROUP BY doc_id")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.entropy(_bytes(spark, sf_dir, 1), "doc_id").select("doc_id", F.round("entropy", 9).alias("entropy"))


def _signed(h: str) -> str:
    """SQL: the name of the signature that the hexadecimal digits h start with."""
    return "CASE " + " ".join(f"WHEN starts_with({h}, '{k}') THEN '{v}'" for k, v in forensics.SIGNATURES.items()) + " END"


#: doc_id, method and payload (hexadecimal digits) by the layouts' rules, read from the stream's bytes.
_PAYLOAD_SQL = f"""(WITH n AS (SELECT doc_id, doc_id % 4 AS k, 'note ' || doc_id AS note FROM documents),
s AS (SELECT doc_id, CASE k WHEN 0 THEN hex('xx{forensics.PAYLOAD_MARK}' || note) || '00' || hex('tail') WHEN 1 THEN lpad(to_base(length(note), 16), 8, '0') || hex(note) || 'FF00FF' WHEN 2 THEN hex('%PDF' || note) ELSE 'FFFFFFFF8081828384' END AS h FROM n),
m AS (SELECT doc_id, h, regexp_extract_all(h, '..') AS b, instr(left(h, 128), hex('{forensics.PAYLOAD_MARK}')) AS mark, CAST('0x' || left(h, 8) AS BIGINT) AS size FROM s),
c AS (SELECT *, regexp_extract_all(substr(h, mark + {2 * len(forensics.PAYLOAD_MARK)}), '..') AS rest, b[5:4 + size] AS body FROM m),
t AS (SELECT *, list_position(rest, '00') AS stop, len(b) >= 8 AND size BETWEEN 1 AND least({forensics.MOST_PAYLOAD}, len(b) - 4) AS fits, len(list_filter(body, lambda x: x BETWEEN '20' AND '7E' OR x IN ('0D', '0A', '09'))) AS shown, {_signed("array_to_string(body, '')")} AS inner_sign, {_signed("h")} AS sign FROM c)
SELECT doc_id, CASE WHEN mark > 0 THEN 'STEGv1 marker' WHEN fits AND (inner_sign IS NOT NULL OR shown / size >= 0.8) THEN '32-bit length prefix (' || coalesce(inner_sign, 'text-like payload') || ')' WHEN sign IS NOT NULL THEN sign || ' signature at LSB stream start' END AS method,
CASE WHEN mark > 0 THEN nullif(array_to_string(rest[1:coalesce(stop - 1, len(rest))], ''), '') WHEN fits AND (inner_sign IS NOT NULL OR shown / size >= 0.8) THEN array_to_string(body, '') WHEN sign IS NOT NULL THEN h END AS payload FROM t)"""


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, note and p: a decoded stream with one of three layouts, or with none."""
    docs = _t(spark, sf_dir, "documents")
    note = F.concat(F.lit("note "), F.col("doc_id").cast("string"))
    sized = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(note)), 8, "0")), F.encode(note, "UTF-8"), F.lit(b"\xff\x00\xff"))
    k = F.col("doc_id") % 4
    stream = (
        F.when(k == 0, F.concat(F.encode(F.concat(F.lit("xx"), F.lit(forensics.PAYLOAD_MARK), note), "UTF-8"), F.lit(b"\x00tail")))
        .when(k == 1, sized).when(k == 2, F.encode(F.concat(F.lit("%PDF"), note), "UTF-8")).otherwise(F.lit(b"\xff\xff\xff\xff\x80\x81\x82\x83\x84"))
    )
    return docs.select("doc_id", note.alias("note"), stream.alias("stream")).select("doc_id", "note", forensics.payload(F.col("stream")).alias("p"))


@query(f"SELECT doc_id, method, decode(unhex(payload)) AS payload FROM {_PAYLOAD_SQL}")
def payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streams(spark, sf_dir).select("doc_id", "p.method", F.decode("p.payload", "ISO-8859-1").alias("payload"))


@query(f"""WITH f AS (SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 4 < 2 AS expected, sha256(CASE WHEN doc_id % 6 = 0 THEN 'other' ELSE 'note ' || doc_id END) AS want, sha256(unhex(payload)) AS got FROM {_PAYLOAD_SQL}),
c AS (SELECT *, got IS NOT NULL AS actual, expected AND got IS NOT NULL AND got = want AS exact, CASE WHEN expected THEN 'supported' WHEN doc_id % 4 = 3 THEN 'clean' ELSE 'unsupported-layout' END AS category FROM f),
s AS (SELECT count(*) AS total_cases, count(*) FILTER (expected) AS supported_case_count, count(*) FILTER (expected AND actual) AS supported_payloads_detected, count(*) FILTER (exact) AS correct_payload_count, count(*) FILTER (category = 'clean') AS clean_case_count,
count(*) FILTER (category = 'clean' AND actual) AS clean_false_positive_count, count(*) FILTER (expected AND NOT actual) AS false_negative_count, count(*) FILTER (expected AND actual AND NOT exact) AS incorrect_payload_count,
count(*) FILTER (category = 'unsupported-layout') AS unsupported_case_count, count(*) FILTER (category = 'unsupported-layout' AND actual) AS unsupported_detection_count FROM c)
SELECT *, round(100.0::DOUBLE * supported_payloads_detected / supported_case_count, 2) AS supported_extraction_success_rate_percent, round(100.0::DOUBLE * correct_payload_count / supported_case_count, 2) AS payload_correctness_rate_percent,
round(100.0::DOUBLE * clean_false_positive_count / clean_case_count, 2) AS clean_false_positive_rate_percent FROM s""")
def stego_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents against what their streams hold."""
    found = _streams(spark, sf_dir)
    k, file = F.col("doc_id"), F.col("doc_id").cast("string").alias("file")
    expected = (k % 5 != 0) & (k % 4 < 2)
    category = F.when(expected, "supported").when(k % 4 == 3, "clean").otherwise("unsupported-layout")
    want = F.sha2(F.when(k % 6 == 0, "other").otherwise(F.concat(F.lit("note "), k.cast("string"))), 256)
    cases = _t(spark, sf_dir, "documents").select(file, category.alias("category"), expected.alias("expected_supported_payload"), want.alias("payload_sha256"))
    return evaluate.hidden_summary(evaluate.hidden_cases(cases, found.select(file, "p.method", "p.payload")))


_PIXELS_SQL = f"(SELECT doc_id, pos // 3 AS px, 2 - pos % 3 AS channel, v FROM {_BYTE_ROWS} JOIN (SELECT doc_id, octet_length(encode(text)) // 3 * 3 AS n FROM documents) USING (doc_id) WHERE pos < n)"


@query(f"""WITH x AS (SELECT * FROM {_PIXELS_SQL}), h AS (SELECT doc_id, channel, v >> 1 AS pair, count(*) AS n, sum(v & 1) AS ones FROM x GROUP BY ALL),
c AS (SELECT doc_id, channel, sum(ones) / sum(n) AS ones_ratio, avg(abs(n - 2 * ones) / n) AS pair_imbalance FROM h GROUP BY ALL),
p AS (SELECT doc_id, (px * 3 + channel) // 8 AS place, sum((v & 1) << (7 - (px * 3 + channel) % 8)) AS packed FROM x GROUP BY ALL),
e AS (SELECT doc_id, entropy(packed) AS entropy FROM p WHERE place < {forensics.MOST_PAYLOAD} GROUP BY doc_id)
SELECT doc_id, (SELECT count(*) FROM x WHERE x.doc_id = e.doc_id) AS bits, {", ".join(f"round(max({v}) FILTER (channel = {i}), 6) AS {n}_{v}" for i, n in enumerate(imaging.CHANNELS) for v in ("ones_ratio", "pair_imbalance"))}, round(any_value(entropy), 6) AS entropy
FROM e JOIN c USING (doc_id) GROUP BY doc_id""")
def image_forensics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-bit findings of each text as the pixels of an image of one row."""
    content = F.encode("text", "UTF-8")
    width = F.floor(F.octet_length(content) / 3).cast("int")
    image = F.struct(F.lit(1).alias("height"), width.alias("width"), F.lit(3).alias("channels"), F.substring(content, F.lit(1), width * 3).alias("data"))
    media = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.lit("image/png").alias("media_type"), content.alias("content"), F.when(width > 0, image).alias("image"))
    done = analyzers.analyse(media, [analyzers.ImageForensics()]).select(F.col("job_id").alias("doc_id"), F.get("modules", F.lit(0))["findings"].alias("f"))
    value = lambda path, kind: F.get_json_object("f", f"$.lsb.{path}").cast(kind)
    channels = [value(f"channel_statistics.{n}.{v}", "double").alias(f"{n}_{v}") for n in imaging.CHANNELS for v in ("ones_ratio", "pair_imbalance")]
    return done.select("doc_id", value("available_lsb_bits", "long").alias("bits"), *channels, value("packed_stream_entropy", "double").alias("entropy")).filter("bits IS NOT NULL")


_MARKS = ("C2PA manifest", "made with Midjourney", "trainedAlgorithmicMedia", "Created by Google Generative AI Gemini", "", "Content Credentials", "jumb DALL-E")


def _listed(markers: dict[str, str]) -> str:
    """SQL: the names of the markers that `low` holds, in order and once."""
    each = ", ".join(f"CASE WHEN contains(low, '{m}') THEN '{n}' END" for m, n in markers.items())
    return f"array_to_string(list_sort(list_distinct(list_filter([{each}], lambda x: x IS NOT NULL))), ',')"


@query(f"""WITH m AS (SELECT doc_id, text, ({list(_MARKS)})[doc_id % 7 + 1] AS mark, CASE doc_id // 7 % 3 WHEN 0 THEN 0 WHEN 1 THEN length(text) // 2 ELSE length(text) END AS place FROM documents),
t AS (SELECT doc_id, lower(left(text, place) || ' ' || mark || ' ' || substr(text, place + 1)) AS low FROM m),
f AS (SELECT doc_id, {_listed({m: m for m in forensics.C2PA})} AS c2pa_markers, {_listed(forensics.AI_CLAIMS)} AS ai_claims, {_listed(forensics.PROVIDERS)} AS providers FROM t)
SELECT *, CASE WHEN ai_claims <> '' THEN 'unverified_ai_origin_claim' ELSE 'inconclusive' END AS assessment FROM f""")
def provenance_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (F.col("doc_id") % 7 + 1).cast("int"))
    # The mark stands at the text's start, middle or end.
    before = F.element_at(F.array(F.lit(0), F.floor(F.char_length("text") / 2).cast("int"), F.char_length("text")), (F.floor(F.col("doc_id") / 7) % 3 + 1).cast("int"))
    text = F.concat(F.substr("text", F.lit(1), before), F.lit(" "), mark, F.lit(" "), F.substr("text", before + 1))
    files = docs.select("doc_id", F.encode(text, "UTF-8").alias("content"))
    found = files.select("doc_id", forensics.provenance(F.col("content")).alias("p"))
    join = lambda c: F.array_join(F.col(f"p.{c}"), ",").alias(c)
    return found.select("doc_id", join("c2pa_markers"), join("ai_claims"), join("providers"), scoring.assessment(F.lit(False), F.size("p.ai_claims") > 0).alias("assessment"))


_ERRORS_SQL = "(SELECT vec_id, label, i AS pos, CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 255) AS DOUBLE) AS e FROM embeddings, range(64) r(i))"


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    return e.select("vec_id", F.col("label").cast("long").alias("label"), "pos", F.floor(F.abs(F.col("x").cast("double")) * 255).cast("double").alias("e"))


@query(f"""SELECT CAST(label AS BIGINT) AS label, round(avg(e), 6) AS mean_error, round(quantile_cont(e, 0.95), 6) AS p95_error, max(e) AS max_error,
round(avg(CASE WHEN e >= 20 THEN 1.0 ELSE 0.0 END), 6) AS highlighted_ratio FROM {_ERRORS_SQL} GROUP BY label""")
def ela_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = forensics.error_statistics(_errors(spark, sf_dir), "label", "e")
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("mean_error", "p95_error", "max_error", "highlighted_ratio")])


@query(f"""SELECT CAST(label AS BIGINT) AS label, round(avg(e) FILTER (pos >= 16 AND pos < 32), 6) AS region_mean, round(avg(e) FILTER (NOT (pos >= 16 AND pos < 32)), 6) AS background_mean,
round(avg(e) FILTER (pos >= 16 AND pos < 32) / avg(e) FILTER (NOT (pos >= 16 AND pos < 32)), 6) AS region_ratio FROM {_ERRORS_SQL} GROUP BY label""")
def region_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = forensics.region_contrast(_errors(spark, sf_dir), "label", "e", (F.col("pos") >= 16) & (F.col("pos") < 32))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("region_mean", "background_mean", "region_ratio")])


@query(f"""WITH s AS (SELECT CAST(label AS BIGINT) AS id, quantile_cont(e, 0.95) AS p95, avg(CASE WHEN e >= 20 THEN 1.0 ELSE 0.0 END) AS h FROM {_ERRORS_SQL} GROUP BY label),
d AS (SELECT h AS eh, p95 AS ep FROM s WHERE id = 0), b AS (SELECT * FROM s, d WHERE id <> 0)
SELECT count(*) AS benign, count(*) FILTER (h > 0) AS benign_highlighted, count(*) FILTER (h >= eh) AS benign_ratio_at_least_edited, count(*) FILTER (p95 >= ep) AS benign_p95_at_least_edited,
(SELECT id FROM b ORDER BY h DESC, id LIMIT 1) AS most_highlighted_benign FROM b""")
def ela_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = forensics.error_statistics(_errors(spark, sf_dir), "label", "e").select(F.col("label").alias("id"), (F.col("label") == 0).alias("known_edit"), "highlighted_ratio", "p95_error")
    return rollups.ela_rollup(s).drop("edited_ratio", "edited_p95")


# --- catalogue and splits --------------------------------------------------------------------------


@query("""SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 0 ELSE 1 END AS label, CASE WHEN d.source < d.lang THEN d.source || ';' || d.lang ELSE d.lang || ';' || d.source END AS identity_ids,
CASE WHEN d.doc_id % 2 = 0 THEN 'unspecified' ELSE 'Deepfakes' END AS manipulation, 'set-' || substr(sha256(d.text), 1, 16) || '-' || printf('%06d', d.doc_id + 1) AS sample_id
FROM documents d JOIN labels l USING (doc_id)""")
def catalog_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    text = F.when(F.col("quality") == 1, " Authentic").otherwise("FAKE ")
    ids = catalog.identities(F.concat("source", F.lit("; "), "lang", F.lit(";;"), "source"))
    tag = F.when(F.col("doc_id") % 2 == 0, " ").otherwise("Deepfakes ")
    return d.select("doc_id", catalog.label(text).alias("label"), F.array_join(ids, ";").alias("identity_ids"), catalog.manipulation(tag).alias("manipulation"), catalog.sample_id("set", F.sha2(F.encode("text", "UTF-8"), 256), F.col("doc_id") + 1).alias("sample_id"))


@query(f"""WITH d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'maybe' ELSE 'real' END AS label, CASE WHEN doc_id % 7 = 0 THEN ' ; ' ELSE 'p1;p2' END AS ids,
CASE WHEN doc_id % 11 = 0 THEN '../' ELSE 'a/' END || doc_id || CASE WHEN doc_id % 13 = 0 THEN '.gif' ELSE '.jpeg' END AS path FROM documents),
s AS (SELECT *, list_transform(string_split(path, '/'), lambda x: CASE x WHEN '..' THEN -1 WHEN '.' THEN 0 WHEN '' THEN 0 ELSE 1 END) AS steps FROM d),
r AS (SELECT CASE WHEN lower(trim(label)) NOT IN {catalog.FAKE + catalog.REAL} THEN 'bad_label' WHEN len(list_filter(string_split(ids, ';'), lambda x: trim(x) <> '')) = 0 THEN 'no_identity'
WHEN list_min([list_sum(steps[1:i]) FOR i IN range(1, len(steps) + 1)]) < 0 THEN 'unsafe_path' WHEN NOT regexp_matches(lower(path), '\\.(jpg|jpeg|png)$') THEN 'bad_suffix' END AS reason FROM s)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def catalog_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    d = _t(spark, sf_dir, "documents").select(
        F.when(k % 5 == 0, "maybe").otherwise("real").alias("label"), F.when(k % 7 == 0, " ; ").otherwise("p1;p2").alias("ids"),
        F.concat(F.when(k % 11 == 0, "../").otherwise("a/"), k.cast("string"), F.when(k % 13 == 0, ".gif").otherwise(".jpeg")).alias("path"),
    )
    path = F.col("path")
    reason = F.when(catalog.label(F.col("label")).isNull(), "bad_label").when(F.size(catalog.identities(F.col("ids"))) == 0, "no_identity").when(~ingest.stays_inside(path), "unsafe_path").when(~ingest.image_suffix(path), "bad_suffix")
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT doc_id + 2 AS line, 'a/' || CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 WHEN doc_id % 23 = 5 THEN -doc_id ELSE doc_id END || '.png' AS path, CASE WHEN doc_id % 8 = 0 THEN 'unsure' ELSE ' Fake' END AS label FROM documents),
f AS (SELECT 'a/' || doc_id || '.png' AS path, sha256(text) AS sha FROM documents),
r AS (SELECT line, path, sha, CASE WHEN lower(trim(label)) <> 'fake' THEN 'bad_label' WHEN sha IS NULL THEN 'missing_file' END AS reason FROM m LEFT JOIN f USING (path)),
p AS (SELECT *, min(line) FILTER (reason IS NULL) OVER (PARTITION BY path) AS first_ FROM r), q AS (SELECT line, sha, coalesce(reason, CASE WHEN line > first_ THEN 'duplicate_path of line ' || first_ END) AS reason FROM p),
c AS (SELECT *, min(line) FILTER (reason IS NULL) OVER (PARTITION BY sha) AS first_ FROM q), t AS (SELECT line, sha, coalesce(reason, CASE WHEN line > first_ THEN 'duplicate_content of line ' || first_ END) AS reason FROM c)
SELECT line, reason, CASE WHEN reason IS NULL THEN 'set-' || left(sha, 16) || '-' || printf('%06d', line - 1) END AS sample_id FROM t""")
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of all documents as files, by lines that repeat paths and miss files, with its rejects."""
    d, k = _t(spark, sf_dir, "documents"), F.col("doc_id")
    file = lambda c: F.concat(F.lit("a/"), c.cast("string"), F.lit(".png"))
    rows = d.select(
        (k + 2).alias("line"), file(F.when(k % 10 == 9, k - 1).when(k % 23 == 5, -k).otherwise(k)).alias("path"), F.when(k % 8 == 0, "unsure").otherwise(" Fake").alias("label"),
        F.lit("p1").alias("identity_ids"), F.lit("g").alias("source_group"), F.lit("").alias("manipulation"),
    )
    good, rejects = catalog.build(rows, d.select(file(k).alias("path"), F.encode("text", "UTF-8").alias("content")), "set")
    kept = good.select((F.element_at(F.split("sample_id", "-"), -1).cast("long") + 1).alias("line"), F.lit(None).cast("string").alias("reason"), "sample_id")
    return kept.unionByName(rejects.select("line", "reason", F.lit(None).cast("string").alias("sample_id")))


_COMPONENTS_SQL = """WITH RECURSIVE r AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 70 = 0),
e AS (SELECT DISTINCT r.k AS a, m.k AS b FROM r JOIN (SELECT c, min(k) AS k FROM r GROUP BY c) m USING (c)), links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
found(key, component) USING KEY (key) AS (SELECT DISTINCT k, k FROM r UNION (SELECT l.a, min(w.component) FROM links l JOIN found w ON l.b = w.key JOIN recurring.found u ON u.key = l.a WHERE w.component < u.component GROUP BY l.a))
SELECT key, component FROM found"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a record of one identity, or of two."""
    o = _t(spark, sf_dir, "orders")
    ids = F.when(F.col("o_orderkey") % 70 == 0, F.array("o_custkey", F.col("o_custkey") + 1)).otherwise(F.array("o_custkey"))
    return o.select(F.col("o_orderkey").alias("key"), ids.alias("identity"))


@query(_COMPONENTS_SQL)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.components(catalog.constraints(_records(spark, sf_dir), "key", ["identity"]))


@query(_COMPONENTS_SQL)
def components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name."""
    return components(spark, sf_dir)


@query("""SELECT sha256(text) AS constraint, count(DISTINCT doc_id % 3) AS splits FROM documents GROUP BY ALL HAVING count(DISTINCT doc_id % 3) > 1""")
def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("constraint"), (F.col("doc_id") % 3).alias("split"))
    return catalog.leaks(d)


@query("""WITH r AS (SELECT d.doc_id % 3 AS split, 1 - l.quality AS label, [d.source, d.lang] AS ids, d.source FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT split, count(DISTINCT i) AS identities FROM (SELECT split, unnest(ids) AS i FROM r) GROUP BY split)
SELECT split, count(*) AS samples, count(*) FILTER (label = 0) AS "real", count(*) FILTER (label = 1) AS fake, any_value(identities) AS identities, count(DISTINCT source) AS source_groups FROM r JOIN p USING (split) GROUP BY split""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    r = d.select((F.col("doc_id") % 3).alias("split"), (1 - F.col("quality")).alias("label"), F.array("source", "lang").alias("identity_ids"), F.col("source").alias("source_group"))
    return catalog.split_summary(r)


@query()
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakage-free split of all records; only counts of components by size and labels come to the driver."""
    found = components_all(spark, sf_dir).withColumn("label", (F.col("key") / 10 % 2).cast("int"))
    return found.join(catalog.split_components(found), "component").select("key", "component", "split")


# --- headers, watermark tries, cleanup ---------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, n_chars % 3000 AS w, 1 + doc_id % 2000 AS h FROM documents)
SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN 'PNG' END AS format, CASE WHEN doc_id % 9 > 0 THEN ['L', 'RGB', 'RGBA'][doc_id % 3 + 1] END AS mode, CASE WHEN doc_id % 9 > 0 THEN w END AS width, CASE WHEN doc_id % 9 > 0 THEN h END AS height,
CASE WHEN doc_id % 9 = 0 OR w = 0 THEN 'unreadable' WHEN w * h > 2000000 THEN 'too_many_pixels' END AS decode_reject FROM d""")
def media_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of PNG files by size and colour; every ninth is cut short."""
    d = _t(spark, sf_dir, "documents")
    number = lambda c: F.lpad(F.hex(c), 8, "0")
    colour = F.element_at(F.array(F.lit("00"), F.lit("02"), F.lit("06")), (F.col("doc_id") % 3 + 1).cast("int"))
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.when(F.col("doc_id") % 9 > 0, F.concat(number(F.col("n_chars") % 3000), number(1 + F.col("doc_id") % 2000), F.lit("08"), colour)).otherwise(""))
    files = d.select("doc_id", F.unhex(head).alias("content"), F.lit("image/png").alias("media_type"))
    found = headers.inspected(files, most_pixels=2_000_000)
    return found.select("doc_id", "header.format", "header.mode", *[F.col(f"header.{c}").cast("long").alias(c) for c in ("width", "height")], "decode_reject")


@query(f"""WITH d AS (SELECT doc_id, n_chars % 1900 + 20 AS w, doc_id * 37 % 1000 + 20 AS h FROM documents), c(no, corner, a, b, c, d) AS (VALUES {", ".join(f"({i}, '{n}', {a}, {b}, {c}, {d})" for i, (n, (a, b, c, d)) in enumerate(watermark.CORNERS.items()))}),
s AS (SELECT doc_id, w, h, unnest(list_distinct([CAST(least({watermark.MOST_SIZE}, greatest({watermark.LEAST_SIZE}, round_even(greatest({watermark.LEAST_BASE}, least({watermark.MOST_SIZE}, round_even(least(w, h) * {watermark.SHARE}::DOUBLE, 0))) * x, 0))) AS BIGINT) FOR x IN [{", ".join(f"{x}::DOUBLE" for x in watermark.SCALES)}]])) AS size FROM d),
t AS (SELECT doc_id, corner, size, CAST(floor(w * a::DOUBLE) AS BIGINT) AS x0, CAST(floor(h * b::DOUBLE) AS BIGINT) AS y0, CAST(floor(w * c::DOUBLE) AS BIGINT) AS x1, CAST(floor(h * d::DOUBLE) AS BIGINT) AS y1 FROM s, c)
SELECT * FROM t WHERE x1 - x0 >= size AND y1 - y0 >= size""")
def watermark_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and template sizes that are looked at in images of many sizes."""
    d = _t(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 1900 + 20).cast("int").alias("w"), (F.col("doc_id") * 37 % 1000 + 20).cast("int").alias("h"))
    return d.select("doc_id", F.inline(watermark.tries(F.col("h"), F.col("w")))).select("doc_id", "corner", *_long("size", "x0", "y0", "x1", "y1"))


@query(f"""SELECT id, CASE WHEN o_custkey % 10 = 0 THEN 'path leaves its folder: ../' || id WHEN o_custkey % 10 = 1 THEN 'path leaves its folder: /reports/' || id END AS failure
FROM {_JOBS_SQL} WHERE updated_at < TIMESTAMP '1996-06-01' AND status NOT IN ('queued', 'processing')""")
def cleanup_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 10
    paths = F.array(F.concat(F.when(k == 0, "../").otherwise("uploads/"), "id"), F.concat(F.when(k == 1, "/reports/").otherwise("reports/"), "id"))
    return jobs.checked_paths(_jobs(spark, sf_dir), F.lit("1996-06-01").cast("timestamp"), paths)


@query("""WITH l AS (SELECT user_id AS id, event_id AS "at", (['queued', 'processing', 'completed', 'failed'])[event_id % 4 + 1] AS status FROM events), s AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY "at") AS before FROM l)
SELECT id, "at", before, status FROM s WHERE NOT CASE WHEN before IS NULL THEN status = 'queued' WHEN before = 'queued' THEN status IN ('processing', 'failed') WHEN before = 'processing' THEN status IN ('completed', 'partially_completed', 'failed') ELSE false END""")
def status_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("queued", "processing", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    log = _t(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), status.alias("status"))
    return streaming.wrong_steps(log, process.allowed_step).select("id", "at", "before", "status")


@query(f"""WITH j AS (SELECT id, status, source_name, o_custkey, created_at, o_orderkey % 3 > 0 AS done, o_orderkey % 2 = 0 AS film FROM {_JOBS_SQL}),
l AS (SELECT id, ['Forensic Risk Assessment', 'Analysis ID: ' || id, 'Status: ' || status, 'Source: ' || source_name, 'Media type: video/mp4', 'SHA-256: ' || sha256(id), 'Size: ' || o_custkey || ' bytes', 'Created: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g')]
|| CASE WHEN done THEN ['Media', 'Code version: 1', 'Analysed: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g'), 'Dimensions: 640 x 360'] || CASE WHEN film THEN ['Duration: 2.500 seconds', 'Frame rate: 25.0 FPS', 'Sampled frames: 3'] ELSE [] END
|| ['Module findings', 'deepfake_detection: completed', 'Version: 1; duration: 5 ms', 'Face-manipulation model score: 25.0%', '{report.SCORE_NOTE}', 'Warning: look twice', '{{"deepfake_probability":0.25}}', 'Analysis warnings', 'sampled'] ELSE [] END
|| ['{report.LIMITATION[:92]}', '{report.LIMITATION[93:]}'] AS lines FROM j)
SELECT id, CAST(unnest(range(len(lines))) AS BIGINT) AS line_no, unnest(lines) AS line FROM l""")
def report_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports of all jobs, those without a result too."""
    film, k = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3
    module = F.struct(F.lit("deepfake_detection").alias("module"), F.lit("completed").alias("status"), F.lit("1").alias("version"), F.lit(5).alias("duration_ms"), F.lit("{}").alias("settings"), F.lit('{"deepfake_probability":0.25}').alias("findings"), F.array(F.lit("look twice")).alias("warnings"))
    result = F.struct(F.lit("1").alias("code_version"), F.col("created_at").alias("analysed_at"), F.lit(640).alias("width"), F.lit(360).alias("height"), F.when(film, 2.5).alias("duration_seconds"), F.when(film, 25.0).alias("frame_rate"), F.lit(3).alias("sampled_frames"), F.array(module).alias("modules"), F.array(F.lit("sampled")).alias("warnings"))
    j = _jobs(spark, sf_dir).select("id", "status", "source_name", F.lit("video/mp4").alias("media_type"), F.sha2(F.col("id").cast("binary"), 256).alias("sha256"), F.col("o_custkey").alias("size_bytes"), "created_at", F.when(k > 0, result).alias("result"))
    return report.full_report(j).select("id", *_long("line_no"), "line")


_FOURCC = "(['avc1', 'hev1', 'mp4v', 'ap4h'])[o_orderkey % 4 + 1]"


@query(f"""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 > 0 THEN {_FOURCC} END AS fourcc, strftime(o_orderdate + to_microseconds(o_orderkey), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS at,
replace(replace(replace(replace(replace('<' || o_orderpriority || '&''">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped,
CASE WHEN o_orderkey % 3 > 0 THEN printf('%.1f%%', o_orderkey % 1000 / 997.0 * 100) ELSE '—' END AS percent, round((o_totalprice::DOUBLE - 1000) / greatest((o_orderkey % 2) * 5000.0::DOUBLE, 1e-6::DOUBLE) * 255, 0) AS stretched FROM orders""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.element_at(F.array(*[F.lit(int.from_bytes(c.encode(), "little")) for c in ("avc1", "hev1", "mp4v", "ap4h")]), (k % 4 + 1).cast("int"))
    low = F.lit(1000.0)
    return _t(spark, sf_dir, "orders").select(
        k.alias("key"), scalar.fourcc(F.when(k % 7 > 0, code).otherwise(0)).alias("fourcc"), scalar.utc_iso(F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + k)).alias("at"),
        scalar.escaped(F.concat(F.lit("<"), "o_orderpriority", F.lit("&'\">"))).alias("escaped"), scalar.percent(F.when(k % 3 > 0, k % 1000 / 997)).alias("percent"),
        F.round(scalar.stretched(F.col("o_totalprice").cast("double"), low, low + (k % 2) * 5000), 0).alias("stretched"),
    )


@query("""SELECT 's' || o_orderkey AS sample_id, 'a/' || o_orderkey || '.png' AS path, CAST(o_orderkey % 2 AS INTEGER) AS label, 'p' || o_custkey || ';q' || o_orderkey % 5 AS identity_ids, o_orderpriority AS source_group, 'set, one' AS dataset, CASE WHEN o_orderkey % 3 = 0 THEN 'say "hi"' ELSE 'unspecified' END AS manipulation, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256 FROM orders""")
def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue written as CSV to the shared folder and read again."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    records = _t(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), text).alias("sample_id"), F.concat(F.lit("a/"), text, F.lit(".png")).alias("path"), (k % 2).cast("int").alias("label"), F.array(F.concat(F.lit("p"), "o_custkey"), F.concat(F.lit("q"), k % 5)).alias("identity_ids"),
        F.col("o_orderpriority").alias("source_group"), F.lit("set, one").alias("dataset"), F.when(k % 3 == 0, 'say "hi"').otherwise("unspecified").alias("manipulation"), F.sha2(text.cast("binary"), 256).alias("sha256"),
    )
    at = shared_folder(spark, "catalog")
    media.write_catalog(records, at)
    return media.read_catalog(spark, at).withColumn("identity_ids", F.array_join("identity_ids", ";"))


@query(f"SELECT id, 'forensic_risk_assessment' AS report_type, 'leads only' AS disclaimer, status, error IS NULL AS no_error FROM {_JOBS_SQL}")
def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON, read again; a null field has to be there."""
    made = report.json_report(_jobs(spark, sf_dir).select("id", "status", "error"), "leads only")
    body = F.from_json("report", "report_type string, disclaimer string, analysis struct<id:string,status:string,error:string>").alias("r")
    told = made.select("id", body, F.contains("report", F.lit('"error":')).alias("named"))
    return told.filter("named").select("id", "r.report_type", "r.disclaimer", "r.analysis.status", F.col("r.analysis.error").isNull().alias("no_error"))


_KERNELS_SQL = ", ".join(f"({no}, {y - 2}, {x - 2}, {int(kernel[y, x])}, {divisor})" for no, (kernel, divisor) in enumerate(pixels.SRM) for y in range(5) for x in range(5) if kernel[y, x])


@query(f"""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, least(255, floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 255)) / 255 AS v FROM embeddings, range(64) r(i)), k(no, dy, dx, w, d) AS (VALUES {_KERNELS_SQL}),
c AS (SELECT vec_id, no, p.y - dy AS y, p.x - dx AS x, sum(v * w / d) AS s FROM p, k WHERE p.y - dy BETWEEN 0 AND 7 AND p.x - dx BETWEEN 0 AND 7 GROUP BY ALL)
SELECT vec_id, CAST(no AS BIGINT) AS filter, round(sum(abs(s)) / 64, 9) AS level FROM c GROUP BY ALL""")
def residual_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute high-pass residual of each vector as a grey image of eight by eight, by filter."""
    values = F.transform(F.slice("embedding", 1, 64), lambda x: F.lpad(F.hex(F.least(F.lit(255), F.floor(F.abs(x.cast("double")) * 255)).cast("long")), 2, "0"))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(values, "")).alias("data"))
    levels = _t(spark, sf_dir, "embeddings").select("vec_id", imaging.residuals(image)["levels"].alias("l"))
    each = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda f: F.struct(f.cast("long").alias("filter"), F.round(F.get("l", f * 3), 9).alias("level")))
    return levels.select("vec_id", F.inline(each))


# --- metrics ---------------------------------------------------------------------------------------

_SCORED_SQL = "(SELECT doc_id, quality AS label, (n_chars % 1000) / 1000 AS score, lang, n_chars FROM documents JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") % 1000 / 1000).alias("score"), "lang", "n_chars")


_CONFUSION = "count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn"
_RATES = """round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 6) AS specificity, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 6) AS f1"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"SELECT {_CONFUSION} FROM {_SCORED_SQL}")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_scored(spark, sf_dir), 0.5)


@query(f"WITH c AS (SELECT {_CONFUSION} FROM {_SCORED_SQL}) SELECT *, {_RATES} FROM c")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.rates(metrics.confusion(_scored(spark, sf_dir), 0.5)))


@query(f"WITH c AS (SELECT lang, {_CONFUSION} FROM {_SCORED_SQL} GROUP BY lang) SELECT *, {_RATES} FROM c")
def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.rates(metrics.confusion(_scored(spark, sf_dir), 0.5, ["lang"])))


@query(f"""WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM {_SCORED_SQL}),
s AS (SELECT sum(r) FILTER (label = 1) AS ranks, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n FROM r)
SELECT round((ranks - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM s""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_scored(spark, sf_dir)))


@query(f"""WITH b AS (SELECT (score >= 0.1)::INT + (score >= 0.2)::INT + (score >= 0.3)::INT + (score >= 0.4)::INT + (score >= 0.5)::INT + (score >= 0.6)::INT + (score >= 0.7)::INT + (score >= 0.8)::INT + (score >= 0.9)::INT AS bin, count(*) AS n, avg(score) AS s, avg(label) AS y FROM {_SCORED_SQL} GROUP BY bin)
SELECT round(sum(n * abs(s - y)) / sum(n), 6) AS ece FROM b""")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.calibration_error(_scored(spark, sf_dir)))


@query(f"SELECT round(avg((score - label) * (score - label)), 6) AS brier_score FROM {_SCORED_SQL}")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.brier(_scored(spark, sf_dir)))


_PREDICTIONS_SQL = """(SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'read_error' WHEN d.n_chars < 300 THEN 'no_face' ELSE 'evaluated' END AS status, (d.n_chars % 1000) / 1000 AS s FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "read_error").when(F.col("n_chars") < 300, "no_face").otherwise("evaluated")
    score = F.col("n_chars") % 1000 / 1000
    return d.select("doc_id", status.alias("status"), F.when(status == "evaluated", score).alias("score"), F.when(status == "evaluated", (score >= 0.5).cast("long")).alias("prediction"))


@query(f"SELECT doc_id, status, CASE WHEN status = 'evaluated' THEN s END AS score, CASE WHEN status = 'evaluated' THEN CAST(s >= 0.5 AS BIGINT) END AS prediction FROM {_PREDICTIONS_SQL}")
def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir)


@query(f"SELECT count(*) AS samples, count(*) FILTER (status = 'evaluated') AS evaluated, count(*) FILTER (status = 'no_face') AS no_face, count(*) FILTER (status = 'read_error') AS read_errors FROM {_PREDICTIONS_SQL}")
def prediction_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_counts(_predictions(spark, sf_dir))


# --- roll-ups --------------------------------------------------------------------------------------

_STEGO_SQL = "(SELECT doc_id, doc_id % 3 = 0 AS expected, n_chars % 4 <> 0 AS actual, n_chars % 5 <> 0 AS correct, doc_id % 3 = 1 AS clean FROM documents)"


def _stego(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("doc_id"), F.col("n_chars")
    return _t(spark, sf_dir, "documents").select("doc_id", (k % 3 == 0).alias("expected"), (n % 4 != 0).alias("actual"), (n % 5 != 0).alias("correct"), (k % 3 == 1).alias("clean"))


@query(f"SELECT doc_id, CASE WHEN expected AND NOT actual THEN 'FALSE_NEGATIVE' WHEN expected AND NOT correct THEN 'INCORRECT_PAYLOAD' WHEN NOT expected AND actual THEN 'UNEXPECTED_DETECTION' ELSE 'PASS' END AS outcome FROM {_STEGO_SQL}")
def stego_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stego(spark, sf_dir).select("doc_id", rollups.stego_outcome(F.col("expected"), F.col("actual"), F.col("correct")).alias("outcome"))


@query(f"""WITH c AS (SELECT count(*) AS total_cases, count(*) FILTER (expected) AS supported, count(*) FILTER (expected AND actual) AS extracted, count(*) FILTER (expected AND correct) AS exact,
count(*) FILTER (NOT expected AND clean) AS clean_cases, count(*) FILTER (NOT expected AND clean AND actual) AS false_positives, count(*) FILTER (expected AND NOT actual) AS false_negatives,
count(*) FILTER (expected AND actual AND NOT correct) AS incorrect_payloads, count(*) FILTER (NOT expected AND NOT clean AND actual) AS unsupported_detected FROM {_STEGO_SQL})
SELECT *, round(100.0::DOUBLE * extracted / supported, 6) AS extraction_rate, round(100.0::DOUBLE * false_positives / clean_cases, 6) AS false_positive_rate FROM c""")
def stego_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rollups.stego_rollup(_stego(spark, sf_dir)))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    task = F.element_at(F.array(*[F.lit(t) for t in rollups.TASKS]), (F.col("turn") % 5 + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(s) for s in rollups.STATUSES]), (F.length("text") % 4 + 1).cast("int"))
    return c.select(F.col("conv_id").alias("participant"), task.alias("task"), status.alias("status"), F.length("text").alias("n"))


_ANSWERS_SQL = f"(SELECT conv_id, ([{', '.join(repr(t) for t in rollups.TASKS)}])[turn % 5 + 1] AS task, ([{', '.join(repr(t) for t in rollups.STATUSES)}])[length(text) % 4 + 1] AS status, length(text) AS n FROM conversations)"


@query(f"SELECT task, {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}''' for s in rollups.STATUSES)} FROM {_ANSWERS_SQL} GROUP BY task")
def study_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.study_task_counts(_answers(spark, sf_dir))


@query(f"SELECT ([{', '.join(repr(t) for t in rollups.RATINGS)}])[n % 3 + 1] AS rating, count(*) FILTER (n % 6 < 5) AS responses, round(avg(n % 6 + 1) FILTER (n % 6 < 5), 6) AS mean FROM {_ANSWERS_SQL} GROUP BY rating")
def study_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.element_at(F.array(*[F.lit(t) for t in rollups.RATINGS]), (F.col("n") % 3 + 1).cast("int"))
    r = _answers(spark, sf_dir).select(rating.alias("rating"), F.when(F.col("n") % 6 < 5, F.col("n") % 6 + 1).alias("value"))
    return _rounded(rollups.study_ratings(r))


@query("""WITH p AS (SELECT 'P' || page_id AS id, page_id % 4 AS k FROM pages)
SELECT id, CASE k WHEN 1 THEN id || ': unknown statuses: maybe' WHEN 2 THEN id || ': result_clarity lies outside 1..5' WHEN 3 THEN id || ': tasks are not the five asked for|' || id || ': most_confusing is missing or over 500 characters' ELSE '' END AS errors FROM p""")
def study_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    tasks = F.create_map(*[x for i, t in enumerate(rollups.TASKS) for x in (F.lit(t), F.when((k == 1) & F.lit(i == 2), "maybe").otherwise("success"))])
    tasks = F.when(k == 3, F.map_filter(tasks, lambda a, _: a != "report")).otherwise(tasks)
    ratings = F.create_map(*[x for i, r in enumerate(rollups.RATINGS) for x in (F.lit(r), F.when((k == 2) & F.lit(i == 1), 6).otherwise(F.lit(None if i == 2 else 4).cast("int")))])
    p = _t(spark, sf_dir, "pages").select(F.concat(F.lit("P"), "page_id").alias("id"), tasks.alias("tasks"), ratings.alias("ratings"), F.when(k == 3, F.repeat(F.lit("x"), 501)).otherwise("ok").alias("most_confusing"), F.lit("").alias("recommended_change"))
    return rollups.study_errors(p).select("id", F.array_join("errors", "|").alias("errors"))


# --- results and views -----------------------------------------------------------------------------


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id")
    status = [F.lit("completed"), F.when(F.col("doc_id") % 3 == 0, "skipped").otherwise("completed"), F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("completed")]
    told = [F.array(F.lit("unsigned claims")), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("no checkpoint"))).otherwise(F.array().cast("array<string>")), F.array().cast("array<string>")]
    modules = F.array(*[F.struct(F.lit(m).alias("module"), s.alias("status"), w.alias("warnings"), F.array(F.concat(F.lit(f"{m}/"), "doc_id")).alias("artifacts")) for m, s, w in zip(report.MODULES, status, told)])
    return d.select("doc_id", modules.alias("modules"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("sampled"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


@query(f"""SELECT doc_id, 'media_authenticity' AS module, 'completed' AS status FROM documents UNION ALL SELECT doc_id, 'deepfake_detection', CASE WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'completed' END FROM documents
UNION ALL SELECT doc_id, 'image_forensics', CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'completed' END FROM documents""")
def module_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir)
    return report.union_modules([r.select("doc_id", F.col("modules")[i].alias("m")).select("doc_id", "m.module", "m.status") for i in range(3)])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 7 = 0 THEN 'partially_completed' ELSE 'completed' END AS status FROM documents")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("doc_id", jobs.status_of(F.col("modules")).alias("status"))


@query("""SELECT doc_id, 'unsigned claims' AS warning FROM documents UNION ALL SELECT doc_id, 'sampled' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'no checkpoint' FROM documents WHERE doc_id % 3 = 0""")
def warning_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("doc_id", F.explode(report.warnings(F.col("warnings"), F.col("modules"))).alias("warning"))


@query("SELECT doc_id, unnest(['media_authenticity/', 'deepfake_detection/', 'image_forensics/']) || doc_id AS artifact FROM documents")
def artifact_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("doc_id", F.explode(report.artifacts(F.col("modules"))).alias("artifact"))


@query("""SELECT doc_id, 'exif data / lang' AS label, lang AS value FROM documents WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id, 'exif data / source', source FROM documents WHERE doc_id % 4 > 0
UNION ALL SELECT doc_id, 'Metadata', 'No metadata available for this case' FROM documents WHERE doc_id % 4 = 0""")
def metadata_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    nested = F.when(F.col("doc_id") % 4 > 0, F.create_map(F.lit("exif_data"), tags))
    return report.metadata_rows(_t(spark, sf_dir, "documents").select("doc_id", nested.alias("metadata")), "doc_id", "metadata")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'completed' END AS status FROM documents")
def module_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("doc_id", report.module_named(F.col("modules"), "deepfake_detection")["status"].alias("status"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Strong AI-origin evidence' WHEN doc_id % 3 = 1 THEN 'Unverified AI-origin claim' WHEN doc_id % 2 = 0 THEN 'Model score ' || printf('%.1f%%', (doc_id % 8) / 8.0 * 100) ELSE 'Inconclusive' END AS headline FROM documents""")
def case_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("strong_ai_origin_evidence"), F.lit("unverified_ai_origin_claim"), F.lit("inconclusive")), (k % 3 + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", report.headline(kind, k % 8 / 8, F.when(k % 2 == 0, "completed").otherwise("skipped")).alias("headline"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id""")
def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _t(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("at"))
    return streaming.latest_status(log).select(F.col("id").alias("user_id"), "status")


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = streaming.event_counts(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return counted.select(F.unix_micros("window.start").alias("hour"), "event_type", "n")


@query("SELECT event_id AS id, event_type AS status FROM events")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events that have arrived, through a stream into the shared folder, as a status log."""
    at = shared_folder(spark, "stream")
    source = spark.readStream.schema(_t(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log = source.select(F.col("event_id").alias("id"), F.col("event_type").alias("status"))
    streaming.run_available(log, f"{at}/state", lambda batch, no: batch.write.mode("overwrite").parquet(f"{at}/log/batch={no}")).awaitTermination()
    return spark.read.parquet(f"{at}/log").select("id", "status")
