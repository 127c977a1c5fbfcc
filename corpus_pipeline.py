"""Corpus pipeline over `documents`: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; `run` writes every result as
Parquet in the shared checkpoint folder and reads it again, so a lost executor costs at most the stage at hand; a table goes when the
next one is written. All but the last stage return the columns of documents. Null texts stay null until the last stage, where they have no tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, pii, quality_fm, simhash_vp
from gridloom.llm.common import discard, read, shared_folder
from gridloom.llm.queries import vocabulary

#: SQL can express none of classifier, fingerprint links and merges; the tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled rows of the stage's own input."""
    return quality_fm.accepted(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: Jaccard similarity of 0.8 or more on five-word shingles."""
    return simhash_vp.deduplicated(docs, k=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), "document")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the hashes of ids and decoded bytes, and the ids themselves."""
    return bpe.round_trip(docs, *vocabulary(), keep_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        discard(before)  # nothing reads it any more; the given table stays
        docs._stored_at = f"{folder}/{name}"
    return docs
