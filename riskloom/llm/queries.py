"""The registered queries: one per operator, over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (bpe, line_dedup, merkle, mixing, oddsketch, quality_classifier, quality_rules,
                          sharding, simhash, spelling, substring, syncmers, warc)
from riskloom.llm.common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of lines with a word, of lines deleted, and the
    digest of the text that is left."""
    out = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "kept")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of whole documents, written and read back."""
    path = scratch_path(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    sharding.write_shards(docs, path)
    schema = docs.select("doc_id").schema.add("slot", "integer").add("shard", "string")
    return spark.read.schema(schema).parquet(path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    warc.export_warc(spark, path, f"{path}/files")
    return warc.described(warc.read_warc(spark, f"{path}/files"), warc.payloads(spark, path))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.without_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    comp = simhash.near_components(table(spark, sf_dir, "documents"))
    return comp.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_neighbours(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_oddsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    comp = oddsketch.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return comp.select("doc_id", "n_shingles", "component_id",
                       F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.verified(merkle.manifest(docs, merkle.tampered_text())).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_quality_rules, op3_sharding, op4_warc, op5_quality_classifier, op6_mixing,
    op7_substring_dedup, op8_bpe, op9_simhash, op10_syncmers, op11_spelling,
    op12_oddsketch, op13_merkle)}
