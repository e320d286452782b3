"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaymark.llm import decontaminate, packing, quality, simhash
from quaymark.llm.tokens import default_tokenizer
from quaymark.sources.shared import new_path, write_parquet


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.kept(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return simhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest is packed into sequences: a row for each piece, with its ids."""
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("quality rules", keep_good),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The stages fit, hash and tokenize, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in turn to ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        write_parquet(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
