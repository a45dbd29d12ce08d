"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

language        documents in no language (null, or without a letter) go
near_duplicates of each class of near copies the document with the smallest id stays
decontaminate   documents that cover a benchmark item go
secrets         secrets are masked in the text where they stand, and n_chars follows; no document goes
tokens          the whole texts as BPE ids

Defined results: all stages but the last return the columns of `documents` (COLUMNS); other columns of the input, whatever their names, go.
Texts are taken whole. Nulls in other columns than text pass; a null id is an id like any other. Rows equal in id and text
are one row from near_duplicates on. Of near copies with one id the one with the smaller text hash stays. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontam, jaccard, langid, secrets
from quarry.llm.common import kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go; the others keep their rows as they are."""
    samples = langid.sample(langid.labelled(docs))
    return langid.identify(docs.select(*COLUMNS), samples).where(f"lang_pred <> '{langid.UNKNOWN}'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return jaccard.representatives(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.tiled(docs.select(*COLUMNS), benchmark).where(F.size("tiles") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    found = secrets.scanned(docs.select(*COLUMNS), secrets.train(secrets.findings(spark)), path="source")
    masked = F.exists("secrets", lambda s: s["secret"])
    return secrets.masked(found.withColumn("_masked", masked)).withColumn("n_chars", F.when(F.col("_masked"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text in place of the text."""
    import public_tokenizers

    encoded = bpe.encode(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", mask_secrets), ("tokens", tokens)]
#: No SQL expresses the stages; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
