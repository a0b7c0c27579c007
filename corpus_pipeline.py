"""The corpus pipeline over ``documents``: quality rules, toxicity, near duplicates, mixing, byte-level BPE.

Every stage reads all rows that the one before kept. Null, empty and very long texts, repeated rows and ids,
nulls in any column and empty tables are the stages' operators' defined cases; see there.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicfeed.llm import byte_bpe, mixing, near_dup, quality_rules, toxicity
from civicfeed.llm.common import shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs).filter("kept").select(*docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to this stage's labelled input, does not predict as toxic."""
    model = toxicity.trained(spark, sf_dir, docs)
    return toxicity.score(docs, model).filter(F.col("predicted") == 0).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least doc_id."""
    return near_dup.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each repetition."""
    taken = mixing.mix(docs).filter(F.col("repeats") > 0)
    again = taken.withColumn("cf_turn", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return again.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE ids of each row, their number and digest, and the digest of the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality_rules", keep_good),
    ("toxicity", keep_civil),
    ("ngram_jaccard", keep_distinct),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The stages' EM, trained model and similarity join have no SQL; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
