"""Commands over files: python -m framesift.cli <catalog|splits|stego|ela|corpus|evaluate|study|keyed> …; results are
written, counts printed."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import catalog, corpora, evaluate, imaging, rollups
from .sources import media


def _catalog(spark: SparkSession, a: argparse.Namespace) -> None:
    files = media.files(spark, a.root).withColumn("path", F.substr("path", F.lit(1) + F.locate(a.root.rstrip("/") + "/", F.col("path")) + len(a.root.rstrip("/"))))
    good, rejects = catalog.build(media.metadata_csv(spark, a.metadata), files, a.dataset)
    media.write_catalog(good, a.out)
    media.write_json(rejects, f"{a.out}-rejects")
    rejects.groupBy("reason").count().orderBy("reason").show(truncate=False)
    catalog.label_counts(good).show()


def _splits(spark: SparkSession, a: argparse.Namespace) -> None:
    records = media.read_catalog(spark, a.catalog).withColumn("key", F.xxhash64("sample_id"))
    group = catalog.components(catalog.constraints(records, "key", ["identity_ids", "source_group", "sha256"]))
    placed = records.join(group, "key")
    media.write_splits(placed.join(catalog.split_components(placed), "component").drop("key", "component"), a.out).show()


def _stego(spark: SparkSession, a: argparse.Namespace) -> None:
    cases = media.stego_manifest(spark, a.manifest)
    found = evaluate.images_payloads(media.images(spark, a.root))
    name = F.element_at(F.split("file", "/"), -1)
    rows = evaluate.hidden_cases(cases.withColumn("file", name), found.withColumn("file", name))
    media.write_json(rows, f"{a.out}/cases")
    told = evaluate.hidden_summary(rows)
    media.write_json(told.coalesce(1), f"{a.out}/summary")
    told.show(vertical=True)


def _ela(spark: SparkSession, a: argparse.Namespace) -> None:
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    cases = media.ela_manifest(spark, a.manifest).withColumn("file", name("file"))
    files = media.files(spark, a.root, "*.png").select(name("path").alias("file"), "content")
    rows = evaluate.recompressed_cases(cases, files, media.images(spark, a.root).select(name("path").alias("path"), "image"))
    media.write_json(rows.drop("heatmap"), f"{a.out}/cases")
    told = evaluate.recompressed_summary(rows)
    media.write_json(told.coalesce(1), f"{a.out}/summary")
    told.show(vertical=True, truncate=False)


def _corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    """The cases' images as files, and their manifest."""
    drawn = {"hidden": corpora.hidden_payloads, "coded": corpora.coded}[a.kind](spark)
    media.write_files(drawn.select("file", "content"), f"{a.out}/images")
    case = F.struct(*[c for c in drawn.columns if c not in ("image", "content", "payload", "recipe")], F.lit(imaging.QUALITY).alias("ela_jpeg_quality"), F.lit(imaging.THRESHOLD).alias("highlight_threshold"))
    told = drawn.agg(F.lit(1).alias("schema_version"), F.lit(a.kind).alias("task"), F.array_sort(F.collect_list(case)).alias("cases"))  # a corpus's cases
    media.write_json(told.coalesce(1), f"{a.out}/manifest")


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Metrics of predictions (sample_id, label, score, status) at a threshold."""
    rows = media.csv_rows(spark, a.predictions, "sample_id string, label int, score double, status string").drop("line")
    told = evaluate.catalog_metrics(rows, a.threshold)
    media.write_evaluation(rows.withColumn("prediction", (F.col("score") >= a.threshold).cast("int")), told, a.out)
    told.show(vertical=True)


def _study(spark: SparkSession, a: argparse.Namespace) -> None:
    text = spark.read.option("wholetext", True).text(a.study).select(F.lit(a.study).alias("path"), F.col("value").alias("text"))
    rollups.study_document_errors(text).show(truncate=False)
    people = media.study(spark, a.study)
    rollups.study_errors(people).show(truncate=False)
    rollups.study_task_counts(people.select(F.col("id").alias("participant"), F.explode("tasks").alias("task", "status"))).show()
    rollups.study_summary(people).show(vertical=True, truncate=False)
    rollups.study_ratings(people.select(F.col("id").alias("participant"), F.explode("ratings").alias("rating", "value"))).show()


def _keyed(spark: SparkSession, a: argparse.Namespace) -> None:
    found = media.images(spark, a.image).select("path", imaging.keyed_payload(F.col("image"), F.lit(a.seed), F.lit(a.size)).alias("k"))
    found.select("path", "k.payload", "k.error").write.parquet(a.out)


COMMANDS = {
    "catalog": (_catalog, ("metadata", "root", "dataset", "out")),
    "splits": (_splits, ("catalog", "out")),
    "stego": (_stego, ("manifest", "root", "out")),
    "ela": (_ela, ("manifest", "root", "out")),
    "corpus": (_corpus, ("kind", "out")),
    "evaluate": (_evaluate, ("predictions", "threshold", "out")),
    "study": (_study, ("study",)),
    "keyed": (_keyed, ("image", "seed", "size", "out")),
}


TYPES = {"seed": int, "size": int, "threshold": float}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="framesift")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, given) in COMMANDS.items():
        command = commands.add_parser(name)
        for option in given:
            command.add_argument(option, type=TYPES.get(option, str))
    asked = parser.parse_args(argv)
    COMMANDS[asked.command][0](spark or SparkSession.builder.appName("framesift").getOrCreate(), asked)


if __name__ == "__main__":
    main()
