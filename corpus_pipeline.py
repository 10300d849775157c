"""A training corpus from raw documents: clean, judge by host, deduplicate, redact, pack.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept,
and is written as Parquet before the next one reads it, so a lost executor costs
the stage that runs and no more. All but the last keep the columns of documents.

Rows with null texts are empty documents, which the quality rules reject. An empty
table runs through to an empty result. Further columns, whatever their names, are
carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadence.llm import bottom_k, host_rules, packing, pii_bootstrap, positive_unlabelled
from kadence.sources.staging import new_stage_path, stage, staging_run

#: Tokenization and training have no SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model scores 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return positive_unlabelled.drop_toxic(docs, "text", positive_unlabelled.learn_toxicity(docs, labels))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that fail the rules, and those of hosts that fail them."""
    return host_rules.keep_documents(docs, "doc_id", "text", "source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    return bottom_k.keep_representatives(docs, "doc_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind, and count the characters anew."""
    return pii_bootstrap.redact(docs, "text").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the kept documents, a row per piece with its ids (little-endian 32-bit) and their checksum."""
    pieces = packing.pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    A stage's own tables are removed once its result is written; the results of all stages stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = new_stage_path(spark, name)
        with staging_run(spark):
            docs = stage(step(spark, docs, sf_dir), name, path)
    return docs
