"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup,
mixing sources to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept and returns the columns of ``docs``; the last returns one row of token
ids per row.  Rows that the mix takes twice appear twice.  The operators'
docstrings define what happens to nulls, empty texts and repeated rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, line_dedup, mixing, quality_classifier, simhash
from riskloom.llm.common import written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines."""
    return line_dedup.without_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs, F.array("source"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with their digests."""
    return bpe.encode_documents(docs)


STAGES = [("quality_classifier", classify), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_documents),
          ("mixing", mix_sources), ("bpe", tokenize)]

#: Model fits, fingerprint components and token ids have no SQL form; the
#: pipeline is tested stage by stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and read
    again as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
