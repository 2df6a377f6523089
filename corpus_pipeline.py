"""A training corpus from raw documents: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; what it returns is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from impactloom.llm import mixing, ngram_join, packing, pii, quality
from impactloom.llm.cases import free, known
from impactloom.llm.scratch import Scratch


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged, repeated rows and all.

    Null, empty and blank texts are scored as texts without words; with no labels every score is 0.5, below what is
    accepted; an empty table stays empty.
    """
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near duplicates (five-word shingles, Jaccard 0.8 or more): that of its smallest id, then text hash.

    Texts are told apart by id and text, so of an id's texts some may go and others stay.  Texts without
    words are in no group and stay.  Of rows with equal id and text one stays.
    """
    id_, tie, kept_id, kept_tie = free(docs.columns, "_id_", "_tie", "_kept", "_kept_tie")
    first = ngram_join.first_texts(spark, docs, k=5, percent=80).select(F.col("doc_id").alias(kept_id), F.col("th").alias(kept_tie))
    told = docs.withColumn(id_, known("doc_id")).withColumn(tie, F.xxhash64("text"))
    found = told.join(first, (F.col(id_) == F.col(kept_id)) & (F.col(tie) == F.col(kept_tie)), "left")
    # Rows without words stay as they are; of others, repeats are dropped before and after the shuffle, so none gathers in one task.
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return found.where(F.col(kept_tie).isNotNull()).dropDuplicates([id_, tie]).select(*docs.columns).unionByName(docs.where(~words))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null and empty texts stay, as do repeated rows."""
    return pii.mask_documents(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each whole pass over a document and each run of words of the last pass.

    Texts without words are not taken; rows with equal id, text and source count one by one, and one of them gives the
    other columns of all; a null source is a source; an empty table stays empty.
    """
    return mixing.mix_documents(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row lies in the training sequences, repeated rows one by one; null texts are their end id alone."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trees, masking, permutations and byte-pair encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i > 1:
            scratch.drop(STAGES[i - 2][0])
    return docs
