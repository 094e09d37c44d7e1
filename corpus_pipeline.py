"""Training corpus pipeline: documents through quality rules, language ID, exact and near dedup, and packing.

Each stage gets what its predecessor kept, written as Parquet and read again. The first four return the columns of
documents; packing, the last, returns a row for each piece of a document. SQL can't express the stages (compression
ratios, tokenizers), so ORACLE_SQL is None and tests/llm hold the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import exact_dedup, jaccard_join, langid, packing, quality_rules
from sparkloom.llm.queries import fold, tokenizer
from sparkloom.llm.shared import ready, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return quality_rules.kept_rows(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return langid.kept_rows(docs, langid.learn(docs, fold(5) != 0))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.kept_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("langid", language), ("exact_dedup", exact), ("jaccard_join", near), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if k < len(STAGES) - 1 else docs
    return docs
