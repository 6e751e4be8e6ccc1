"""Registered queries over media evidence that the tables' own content makes: coded images, sample tables, study
summaries, manifests, checkpoints, and the status machine as a stream. They join the catalogue's registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dct
from ..functions.checkpoint import shared_folder
from ..operators import analyzers, imaging, process, rollups, samples, views
from ..sources import checkpoint, manifest
from ..streaming import ingest as streaming
from ..streaming import machine
from .catalogue import _rounded, _t, query

# --- error levels ----------------------------------------------------------------------------------


def _grey_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a grey image of eight by eight."""
    values = F.transform(F.slice("embedding", 1, 64), lambda x: F.lpad(F.hex(F.least(F.lit(255), F.floor(F.abs(x.cast("double")) * 255)).cast("long")), 2, "0"))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(values, "")).alias("data"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", image.alias("image"))


_STEPS = {q: dct.steps(dct.BRIGHTNESS, q).ravel().tolist() for q in (90, 50)}


def _levels_sql(quality: int) -> str:
    return f"""p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, least(255, floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 255)) AS v FROM embeddings, range(64) r(i)),
b AS (SELECT u.u, x.x, cos(pi() * u.u * (2 * x.x + 1) / 16) * CASE WHEN u.u = 0 THEN sqrt(0.125) ELSE 0.5 END AS c FROM range(8) u(u), range(8) x(x)),
f AS (SELECT vec_id, a.u AS u, b.u AS w, floor(sum((v - 128) * a.c * b.c) / any_value(({_STEPS[quality]})[a.u * 8 + b.u + 1]) + 0.5 + 1e-9) * any_value(({_STEPS[quality]})[a.u * 8 + b.u + 1]) AS f
  FROM p JOIN b a ON a.x = p.y JOIN b ON b.x = p.x GROUP BY vec_id, a.u, b.u),
g AS (SELECT vec_id, a.x AS y, b.x AS x, least(255, greatest(0, floor(sum(f * a.c * b.c) + 128 + 0.5 + 1e-9))) AS v FROM f JOIN b a ON a.u = f.u JOIN b ON b.u = f.w GROUP BY vec_id, a.x, b.x),
e AS (SELECT vec_id, abs(p.v - g.v) AS e FROM p JOIN g USING (vec_id, y, x))"""


@query(f"""WITH {_levels_sql(50)}
SELECT vec_id, round(avg(e), 6) AS mean_error, round(quantile_cont(e, 0.95), 6) AS p95_error, CAST(max(e) AS INTEGER) AS max_error, round(avg(CASE WHEN e >= 5 THEN 1.0 ELSE 0.0 END), 6) AS highlighted_ratio FROM e GROUP BY vec_id""")
def error_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error levels of each vector's image after coding at quality 50."""
    told = _grey_images(spark, sf_dir).select("vec_id", imaging.recompression(F.col("image"), quality=50, threshold=5).alias("e"))
    return _rounded(told.select("vec_id", *[f"e.{c}" for c in ("mean_error", "p95_error", "max_error", "highlighted_ratio")]))


@query(f"""WITH {_levels_sql(90)}, k AS (SELECT vec_id, y, x, abs(p.v - g.v) AS e FROM p JOIN g USING (vec_id, y, x)),
h AS (SELECT vec_id, y, x, round_even(e * (255.0::DOUBLE / greatest(max(e) OVER (PARTITION BY vec_id), 1)), 0) AS e FROM k)
SELECT vec_id, round(avg(e) FILTER (y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 4), 4) AS region_mean, round(avg(e) FILTER (NOT (y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 4)), 4) AS background_mean FROM h GROUP BY vec_id""")
def heat_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat inside a box of each vector's image against the rest."""
    told = _grey_images(spark, sf_dir).select("vec_id", imaging.recompression(F.col("image"), region=F.array(*map(F.lit, (1, 2, 5, 6)))).alias("r"))
    return told.select("vec_id", F.round("r.region_mean", 4).alias("region_mean"), F.round("r.background_mean", 4).alias("background_mean"))


# --- study summary ---------------------------------------------------------------------------------


def _participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: statuses and ratings by letters of the text, comments by its first lines."""
    letter = lambda at: F.ascii(F.substring("text", at, 1))
    statuses = F.array(*map(F.lit, rollups.STATUSES))
    tasks = F.create_map(*[x for i, t in enumerate(rollups.TASKS) for x in (F.lit(t), F.get(statuses, letter(3 * i + 2) % 4))])
    ratings = F.create_map(*[x for i, r in enumerate(rollups.RATINGS) for x in (F.lit(r), F.when(letter(5 * i + 1) % 7 > 0, letter(5 * i + 1) % 5 + 1))])
    parts = F.split("text", "\n")
    return _t(spark, sf_dir, "documents").select(F.concat(F.lit("P"), "doc_id").alias("id"), tasks.alias("tasks"), ratings.alias("ratings"), F.get(parts, F.lit(1)).alias("most_confusing"), F.coalesce(F.get(parts, F.lit(2)), F.lit(" ")).alias("recommended_change"))


def _letter(at: int) -> str:
    return f"ascii(substr(text, {at}, 1))"


_PARTICIPANTS_SQL = f"""p AS (SELECT 'P' || doc_id AS id, string_split(text, chr(10)) AS parts,
{", ".join(f"({list(rollups.STATUSES)})[{_letter(3 * i + 2)} % 4 + 1] AS {t}" for i, t in enumerate(rollups.TASKS))},
{", ".join(f"CASE WHEN {_letter(5 * i + 1)} % 7 > 0 THEN {_letter(5 * i + 1)} % 5 + 1 END AS {r}" for i, r in enumerate(rollups.RATINGS))} FROM documents),
c AS (SELECT *, {" AND ".join(f"{t} <> 'not_run'" for t in rollups.TASKS)} AND {" AND ".join(f"{r} IS NOT NULL" for r in rollups.RATINGS)} AS done, parts[2] AS most_confusing, coalesce(parts[3], ' ') AS recommended_change FROM p)"""


@query(f"""WITH {_PARTICIPANTS_SQL}, n AS (SELECT count(*) FILTER (done) AS completed, count(*) FILTER (done AND trim(coalesce(most_confusing, '')) <> '') AS a, count(*) FILTER (done AND trim(recommended_change) <> '') AS b,
{", ".join(f"count(*) FILTER ({t} = '{s}') AS {t}_{s}" for t in rollups.TASKS for s in rollups.STATUSES)}, {", ".join(f"count({r}) AS {r}_n, round(avg({r}), 2) AS {r}_mean" for r in rollups.RATINGS)} FROM c)
SELECT completed = 40 AS study_complete, completed = 40 AS publishable, CAST(40 AS BIGINT) AS required_participants, completed AS completed_participants, a AS most_confusing_comments, b AS recommended_changes,
{", ".join(f"{t}_{s}" for t in rollups.TASKS for s in rollups.STATUSES)}, {", ".join(f"{r}_n, {r}_mean" for r in rollups.RATINGS)} FROM n""")
def study_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = rollups.study_summary(_participants(spark, sf_dir), required=40)
    task = [F.get("task_results", F.lit(i))[s].alias(f"{t}_{s}") for i, t in enumerate(rollups.TASKS) for s in rollups.STATUSES]
    rating = [F.get("rating_results", F.lit(i))[k].alias(f"{r}_{short}") for i, r in enumerate(rollups.RATINGS) for k, short in (("responses", "n"), ("mean", "mean"))]
    return told.select(*[c for c in told.columns if not c.endswith("_results")], *task, *rating)


@query(f"""WITH {_PARTICIPANTS_SQL} SELECT id, 'most_confusing' AS question, most_confusing AS comment FROM c WHERE done AND trim(coalesce(most_confusing, '')) <> ''
UNION ALL SELECT id, 'recommended_change', recommended_change FROM c WHERE done AND trim(recommended_change) <> ''""")
def study_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.study_comments(_participants(spark, sf_dir))


# --- sample tables ---------------------------------------------------------------------------------


def _number(value: Column | int) -> Column:
    return F.lpad(F.hex(F.lit(value) if isinstance(value, int) else value), 8, "0")


def _boxed(kind: str, *bodies: Column | str) -> Column:
    """Hexadecimal digits of a box."""
    body = F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bodies])
    # As a list of one, so that the body, which holds other boxes, is put together once and not again for its size.
    return F.get(F.transform(F.array(body), lambda b: F.concat(_number((F.length(b) / 2 + 8).cast("long")), F.lit(kind.encode().hex()), b)), F.lit(0))


def _listed(rows: Column, entry) -> Column:  # noqa: ANN001
    """A table: its count, then each entry's numbers."""
    return F.concat(F.lit("00000000"), _number(F.size(rows).cast("long")), F.array_join(F.transform(rows, entry), ""))


def _films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as the samples of a film: durations by value, sizes by the properties' length, clicks as key
    frames; three samples in the first chunk and two in each other."""
    day = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    one = F.struct("event_id", (F.floor(F.abs("value")).cast("long") % 50 + 1).alias("delta"), (F.length(F.coalesce("props", F.lit(""))) + 100).cast("long").alias("size"), (F.col("event_type") == "click").alias("key"))
    films = _t(spark, sf_dir, "events").groupBy(day.alias("path")).agg(F.array_sort(F.collect_list(one)).alias("s"))  # a user's day
    n = F.size("s").cast("long")
    chunks = F.when(n <= 3, F.lit(1).cast("long")).otherwise(1 + F.ceil((n - 3) / 2))
    runs = F.when(n <= 3, F.array(F.array(F.lit(1), F.lit(3)))).otherwise(F.array(F.array(F.lit(1), F.lit(3)), F.array(F.lit(2), F.lit(2))))
    keys = F.filter(F.transform("s", lambda s, i: F.when(s["key"], i + 1)), lambda k: k.isNotNull())
    table = _boxed(
        "stbl", _boxed("stts", _listed(F.col("s"), lambda s: F.concat(_number(1), _number(s["delta"])))), _boxed("stsc", _listed(runs, lambda r: F.concat(_number(r[0]), _number(r[1]), _number(1)))),
        _boxed("stsz", "00000000", _listed(F.col("s"), lambda s: _number(s["size"]))), _boxed("stco", _listed(F.sequence(F.lit(1).cast("long"), chunks), lambda c: _number(1000 + c * 10000))), _boxed("stss", _listed(keys, _number)),
    )
    media = _boxed("mdia", _boxed("mdhd", "00" * 12, _number(1000), "00" * 8), _boxed("hdlr", "00" * 8, b"vide".hex(), "00" * 12), _boxed("minf", table))
    whole = F.concat(_boxed("ftyp", b"isom".hex(), "00000200"), _boxed("moov", _boxed("trak", media)))
    return films.select("path", F.unhex(whole).alias("content"))


_SAMPLES_SQL = """e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS path, event_id, CAST(floor(abs(value)) AS BIGINT) % 50 + 1 AS delta, length(coalesce(props, '')) + 100 AS size, event_type = 'click' AS key_frame FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY event_id) - 1 AS sample, coalesce(sum(delta) OVER (PARTITION BY path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t0 FROM e),
c AS (SELECT *, CASE WHEN sample < 3 THEN 1 ELSE 2 + (sample - 3) // 2 END AS chunk FROM n),
s AS (SELECT path, sample, round(CAST(t0 AS DOUBLE) / 1000, 6) AS seconds, round(CAST(delta AS DOUBLE) / 1000, 6) AS duration, CAST(1000 + chunk * 10000 + coalesce(sum(size) OVER (PARTITION BY path, chunk ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size, chunk, key_frame FROM c)"""


@query(f'WITH {_SAMPLES_SQL} SELECT path, sample, seconds, duration, "offset", size, chunk, key_frame FROM s')
def media_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample tables of films of variable rate, read from their boxes."""
    found = _films(spark, sf_dir).select("path", samples.tables(F.col("content")).alias("tables"))
    return _rounded(samples.samples(found))


@query(f"""WITH {_SAMPLES_SQL}, k AS (SELECT *, max(CASE WHEN key_frame THEN sample END) OVER (PARTITION BY path ORDER BY sample) AS decode_from, row_number() OVER (PARTITION BY path, CAST(floor(seconds / 0.05) AS BIGINT) ORDER BY sample) AS r FROM s)
SELECT path, sample, seconds, decode_from FROM k WHERE r = 1""")
def media_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sample of each twentieth of a second, and the key frame to decode from."""
    found = samples.samples(_films(spark, sf_dir).select("path", samples.tables(F.col("content")).alias("tables"))).withColumn("seconds", F.round("seconds", 6))
    return samples.sampled(found, interval_seconds=0.05).select("path", "sample", "seconds", "decode_from")


# --- the status machine as a stream ----------------------------------------------------------------

_STATUS = {"signup": "queued", "view": "processing", "click": "partially_completed", "purchase": "completed", "error": "failed"}


@query(f"""WITH RECURSIVE e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} END AS status, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, status) AS no FROM e),
m AS (SELECT id, no, status, ts, status = 'queued' AS ok, CASE WHEN status = 'queued' THEN status END AS now, CASE WHEN status = 'queued' THEN 'accepted' ELSE 'forbidden' END AS outcome FROM n WHERE no = 1
UNION ALL SELECT id, no, status, ts, step, CASE WHEN step THEN status ELSE now END, CASE WHEN step THEN 'accepted' WHEN now = status THEN 'repeated' ELSE 'forbidden' END FROM (
  SELECT n.*, m.now, CASE WHEN m.now IS NULL THEN n.status = 'queued' {" ".join(f"WHEN m.now = '{b}' THEN n.status IN ({', '.join(repr(x) for x in a)})" for b, a in process.STEPS.items())} ELSE FALSE END AS step FROM m JOIN n ON n.id = m.id AND n.no = m.no + 1))
SELECT id, status, epoch_us(ts) AS "at", outcome FROM m""")
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events that have arrived as a log of steps, a user's day being a job, checked by the stateful stream."""
    at = shared_folder(spark, "machine")
    source = spark.readStream.schema(_t(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    status = F.element_at(F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair]), F.col("event_type"))
    log = source.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("id"), status.alias("status"), F.col("ts").alias("at"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", machine.PROVIDER)
    try:
        streaming.run_available(machine.checked_steps(log), f"{at}/state", lambda batch, no: batch.write.mode("overwrite").parquet(f"{at}/log/batch={no}")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(f"{machine.OUT}, batch int").parquet(f"{at}/log").select("id", "status", F.unix_micros("at").alias("at"), "outcome")


# --- manifests -------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(trim(text, E'\\r\\n')) AS sha256, lang, coalesce(source, '') AS source FROM documents")
def csv_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV with their line breaks, several files, and read back by record."""
    at = shared_folder(spark, "manifest")
    text = F.btrim("text", F.lit("\r\n"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "lang", "source")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n").csv(at)
    read = manifest.csv_records(spark, at, ["source", "doc_id", "lang", "text"])
    return read.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("sha256"), "lang", "source")


# --- checkpoints -----------------------------------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, turn, coalesce(role, 'none') AS role, coalesce(text, '') AS text FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS path, role || '.' || turn AS name, 'U8' AS dtype, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM t""")
def checkpoint_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a container whose tensors are its turns' bytes, read by their ranges."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    turns = F.struct("turn", F.concat(F.lit("module._orig_mod."), F.coalesce("role", F.lit("none")), F.lit("."), "turn").alias("key"), text.alias("data"))
    held = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.array_sort(F.collect_list(turns)).alias("s"))  # one conversation
    held = held.withColumn("ends", F.transform("s", lambda _, i: F.aggregate(F.slice("s", 1, i + 1), F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["data"]))))
    entry = lambda t, i: F.struct(t["key"], F.struct(F.lit("U8").alias("dtype"), F.array(F.octet_length(t["data"]).cast("long")).alias("shape"), F.array(F.get("ends", i) - F.octet_length(t["data"]), F.get("ends", i)).alias("data_offsets")))
    header = F.to_json(F.map_from_entries(F.transform("s", entry)))
    size = F.regexp_replace(F.lpad(F.hex(F.octet_length(header).cast("long")), 16, "0"), "^(..)(..)(..)(..)(..)(..)(..)(..)$", "$8$7$6$5$4$3$2$1")
    data = F.array_join(F.transform("s", lambda t: F.hex(t["data"])), "")
    files = held.select("path", F.concat(F.unhex(size), F.encode(header, "UTF-8"), F.unhex(data)).alias("content"))
    return checkpoint.tensors(files).select("path", "name", "dtype", F.get("shape", F.lit(0)).alias("size"), F.sha2("data", 256).alias("sha256"))


# --- findings as rows ------------------------------------------------------------------------------

_PATHS = ("ela.jpeg_quality", "ela.max_error", "ela.mean_error", "ela.highlighted_pixel_ratio", "lsb.available_lsb_bits", "lsb.channel_statistics.green.ones_ratio", "lsb.channel_statistics.red.pair_imbalance")


@query(f"""WITH {_levels_sql(90)}, s AS (SELECT vec_id, max(e) AS most, round(avg(e), 4) AS mean, round(avg(CASE WHEN e >= 20 THEN 1.0 ELSE 0.0 END), 6) AS share FROM e GROUP BY vec_id),
h AS (SELECT vec_id, CAST(v AS BIGINT) // 2 AS pair, count(*) AS n, sum(CAST(v AS BIGINT) % 2) AS ones FROM p GROUP BY ALL),
l AS (SELECT vec_id, round(sum(ones) / sum(n), 6) AS ones, round(avg(abs(n - 2 * ones) / n), 6) AS pairs FROM h GROUP BY vec_id),
r AS (SELECT vec_id, unnest({list(_PATHS)}) AS path, unnest([90.0::DOUBLE, most, mean, share, 192, ones, pairs]) AS number FROM s JOIN l USING (vec_id))
SELECT vec_id, path, 'number' AS kind, round(number, 6) AS number FROM r""")
def analysis_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's image analysed, and its findings as rows by path."""
    grey = _grey_images(spark, sf_dir)
    media = grey.select(F.col("vec_id").alias("job_id"), F.lit("image/png").alias("media_type"), F.col("image.data").alias("content"), "image")
    rows = views.findings(analyzers.analyse(media)).filter(F.col("path").isin(*_PATHS))
    return rows.select(F.col("job_id").alias("vec_id"), "path", "kind", F.round(F.col("value").cast("double"), 6).alias("number"))
