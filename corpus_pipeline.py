"""From raw documents to packed training sequences. Each stage reads all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import decontamination, jaccard_join, packing, pii, quality_rules
from touchline.llm.tokens import public
from touchline.plans.staging import shared_folder

TOKENIZER = "word_bpe_49k.json"
# bounds of what a task holds at once: bytes that go to a Python worker in one batch, and bytes of a row group while it is written
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
ROW_GROUP = 32 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays. Five-word shingles, a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out."""
    return decontamination.without_phrases(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with the sequence and place that each one gets."""
    return packing.packed_documents(docs, public(TOKENIZER))


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("packing", pack),
]

# an LSTM, an iterated cut and a tokenizer are beyond SQL; the tests check the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH[0])
    spark.conf.set(*BATCH)
    try:
        for k, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    finally:
        spark.conf.set(BATCH[0], before)
    return docs
