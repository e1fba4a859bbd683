"""A corpus pipeline of five of the operators; each stage takes and returns documents, the last what its files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import scratch
from corpusloom.llm.decontaminate import clean_documents
from corpusloom.llm.mixing import mixed_documents
from corpusloom.llm.near_copies import representatives
from corpusloom.llm.quality import good_documents
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.token_output import token_output
from corpusloom.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (10) accepts."""
    return good_documents(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: fingerprints that link (6) with an exact check, then all other pairs of a five-word Jaccard similarity of 0.8 or more."""
    ship(spark)
    return representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated (3)."""
    return clean_documents(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document (8)."""
    ship(spark)
    return mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, written and read back (2)."""
    ship(spark)
    return token_output(docs, vocabulary("byte_bpe_50k.json"), shard_tokens=1 << 18, cached=30_000)  # the stages before leave less memory than the query has


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("token_output", token_stage)]

ORACLE_SQL = None  # hash functions, a fitted classifier and a tokenizer: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
