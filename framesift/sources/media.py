"""Media and table sources and sinks, all with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, forensics, imaging, ingest
from . import manifest

METADATA = "path string, label string, identity_ids string, source_group string, manipulation string"
CATALOG = "sample_id string, path string, label int, identity_ids string, source_group string, dataset string, manipulation string, sha256 string"
STEGO_CASES = "schema_version int, task string, cases array<struct<id:string,file:string,category:string,seed:long,payload_size:int,payload_sha256:string,expected_supported_payload:boolean,image_sha256:string>>"
ELA_CASES = "schema_version int, task string, interpretation_boundary string, cases array<struct<id:string,file:string,category:string,seed:long,known_edit:boolean,known_edit_region_xyxy:array<int>,ela_jpeg_quality:int,highlight_threshold:int,image_sha256:string>>"
LEDGER = "id string, status string, source_name string, source_path string, media_type string, sha256 string, size_bytes long, created_at timestamp, updated_at timestamp, error string, result string"
STUDY = "schema_version int, task string, participants array<struct<id:string,tasks:map<string,string>,ratings:map<string,int>,most_confusing:string,recommended_change:string>>"


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files: path, modificationTime, length, content; content is only read where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def catalogued(spark: SparkSession, path: str, most: int = ingest.MAX_UPLOAD_BYTES) -> DataFrame:
    """Files with type, hash and reject reason; files over the limit are refused before they are read."""
    found = files(spark, path)
    good = ingest.ingest(found.filter(F.col("length") <= most), most=most)
    large = found.filter(F.col("length") > most).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("string").alias("sha256"), F.col("length").alias("size_bytes"), F.lit("too_large").alias("reject_reason"))
    return good.unionByName(large)


def images(spark: SparkSession, path: str, most_pixels: int = 40_000_000) -> DataFrame:
    """Image files: path, image (imaging.IMAGE) and reject_reason, null for those that are decoded; one row a
    file, so undecodable and too large ones stay as rejects."""
    decoded = spark.read.format("image").load(path).select("image.*")
    image = F.struct("height", "width", F.col("nChannels").alias("channels"), "data")
    reason = F.when(F.col("height") < 0, "unreadable").when(~ingest.within_pixels(F.col("width"), F.col("height"), most_pixels), "too_many_pixels")
    return decoded.select(F.col("origin").alias("path"), F.when(reason.isNull(), image).cast(imaging.IMAGE).alias("image"), reason.alias("reject_reason"))


def with_images(media: DataFrame, decoded: DataFrame) -> DataFrame:
    """media (…, path) with the image of its file, null where there is none; paths are compared without a scheme."""
    bare = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    return media.withColumn("_at", bare(F.col("path"))).join(decoded.select(bare(F.col("path")).alias("_at"), "image"), "_at", "left").drop("_at")


def with_frame_files(frames: DataFrame, decoded: DataFrame) -> DataFrame:
    """frames (…, artifact) with the image of the file of that name, null where there is none; names are unique."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return frames.withColumn("_name", name("artifact")).join(decoded.select(name("path").alias("_name"), "image"), "_name", "left").drop("_name")


def image_signals(decoded: DataFrame) -> DataFrame:
    """path, signals (imaging.low_bits) and hidden (forensics.payload) of decoded images."""
    told = decoded.filter("image IS NOT NULL").select("path", imaging.low_bits(F.col("image")).alias("signals"))
    return told.withColumn("hidden", forensics.payload(F.col("signals.head")))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of CSV files with headers that have to name all columns of the schema, in any order; extra ones are left
    out. line: the number of the record in its file, the header being the first; cells may hold line breaks."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = [part.split()[1] for part in schema.split(", ")]
    rows = manifest.csv_records(spark, path, names)
    return rows.select(*[F.nullif(F.col(n), F.lit("")).try_cast(t).alias(n) for n, t in zip(names, types)], "line")


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    return csv_rows(spark, path, METADATA)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    rows = required(spark.read.option("header", True).csv(path), [part.split()[0] for part in CATALOG.split(", ")])
    typed = rows.select(*[F.col(n).try_cast(t).alias(n) for n, t in (part.split() for part in CATALOG.split(", "))])
    return typed.withColumn("identity_ids", F.split("identity_ids", ";"))


def write_catalog(records: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with the identities joined; `by` gives a folder for each value, such as the split."""
    flat = records.withColumn("identity_ids", F.array_join("identity_ids", ";"))
    writer = flat.write.option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_splits(records: DataFrame, path: str) -> DataFrame:
    """Each split's records under `split=…`, ordered by sample_id inside files that follow each other, and the summary of all splits as JSON; gives the summary."""
    # By ranges of both: a split may hold most rows, and is then written by many tasks, each a stretch of its ids.
    write_catalog(records.repartitionByRange("split", "sample_id").sortWithinPartitions("split", "sample_id"), f"{path}/splits", "split")
    told = catalog.split_summary(records)
    write_json(told.coalesce(1), f"{path}/split_summary")
    return told


def write_evaluation(rows: DataFrame, metrics: DataFrame, path: str) -> None:
    """Predictions as CSV, metrics as JSON, and the confusion matrix as CSV of actual by predicted."""
    rows.write.option("header", True).csv(f"{path}/predictions")
    write_json(metrics.coalesce(1), f"{path}/metrics")
    line = lambda actual, real, fake: F.struct(F.lit(actual).alias("actual"), F.col(real).alias("real"), F.col(fake).alias("fake"))
    metrics.select(F.inline(F.array(line("real", "tn", "fp"), line("fake", "fn", "tp")))).coalesce(1).write.option("header", True).csv(f"{path}/confusion_matrix")


def write_artifacts(found: DataFrame, path: str) -> None:
    """job_id, module, kind, name, content as a table by kind; bytes stay bytes and are never run."""
    found.write.partitionBy("kind").parquet(path)


#: Files that one call writes one by one.
MOST_FILES = 1000


def write_files(rows: DataFrame, folder: str) -> None:
    """Each row (file, content) as a file of its own, through Spark's file systems; for corpora of up to MOST_FILES, more are
    an error. Tables of artefacts go to write_artifacts."""
    n = rows.count()
    if n > MOST_FILES:
        raise ValueError(f"{n} files, {MOST_FILES} are written one by one")
    spark = rows.sparkSession
    for r in rows.select("file", "content").toLocalIterator():
        if "/" in r["file"] or r["file"] in ("", ".", ".."):
            raise ValueError(f"not a file's name: {r['file']!r}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['file']}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(r["content"]))
        finally:
            out.close()


def create_ledger(spark: SparkSession, name: str) -> None:
    """The job ledger's table, if it is not there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({LEDGER}) USING parquet")


def stego_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STEGO_CASES).option("multiLine", True).json(path).select(F.inline("cases"))


def ela_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ELA_CASES).option("multiLine", True).json(path).select("interpretation_boundary", F.inline("cases"))


def study(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STUDY).option("multiLine", True).json(path).select(F.inline("participants"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; null fields are kept."""
    df.write.option("ignoreNullFields", "false").json(path)
