"""Corpus pipeline: language ID, SimHash near-dedup, decontamination, secret scans, mixing.

Each stage works on all that the one before kept, written as Parquet and read again by its caller.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import decontam, langid, mixing, secrets, simhash
from framesift.llm.common import crc_fold, release, remove, shared_folder, stored_so_far, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; `lang` stays as given.

    Null texts and texts without letters go; repeated rows share their fate; without any labelled text there is
    no model and nothing stays; other columns are dropped.
    """
    model = langid.train(docs.filter(crc_fold(F.col("doc_id"), 3) != 1))
    return langid.accepted(docs, model).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of least id; of rows that repeat an id, all stay.

    Null and empty texts are near-duplicates of each other; rows without an id always stay.
    """
    others = simhash.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, an empty benchmark has none."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret's span replaced in the text and n_chars following.

    Null texts stay null, with a null n_chars.
    """
    hidden = secrets.redact(docs.select(*COLUMNS), secrets.train(docs))
    return hidden.withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take of every document; a null text has none, a null source is one of its own, ordered last."""
    return mixing.mix_sources(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("secret_scan", hide_secrets), ("mixing", mix)]

#: Stages 1 to 4 rest on trained models, fingerprints and embeddings that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stage's documents written to the shared checkpoint folder; of these only the
    last are kept, as the result reads them."""
    at = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for no, (_, stage) in enumerate(STAGES):
        before = stored_so_far(spark)
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{no}")
        docs = spark.read.parquet(f"{at}/{no}")
        release(spark, before)
        if no:
            remove(spark, f"{at}/{no - 1}")
    return docs
