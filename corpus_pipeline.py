"""A corpus pipeline of five stages: each calls one operator and its decisions take effect.

Every stage gets the documents its predecessor kept (written as Parquet and read
again) and returns the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import decontamination, langid, packing, secrets_scan, simhash
from claimlens.llm.common import read_table, written
from claimlens.llm.queries import RANKS


def _text_hash() -> Column:
    """The text_hash of the operators, where a null text is an empty one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents that ``rejected`` doesn't name by doc_id and text_hash."""
    named = rejected.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].eqNullSafe(named["__id"]) & (_text_hash() == named["__hash"])
    return docs.join(named, same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that op6 calls undetermined, those without a letter, and sets the language of those that
    have none; texts in several languages stay. The tagger learns from the documents themselves."""
    return langid.keep(docs, langid.train(docs, F.lit(True)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, that of the smallest doc_id (of its texts the one with
    the smallest hash; of repeated rows one). Rows without doc_id stay."""
    classes = written(simhash.near_duplicates(docs).filter("doc_id IS NOT NULL"), "classes")
    first = classes.filter("doc_id = component_id").groupBy("class_root").agg(F.min("text_hash").alias("kept"))
    rejected = classes.join(first, "class_root").filter("doc_id <> component_id OR text_hash <> kept")
    kept = _without(docs, rejected)
    repeated = classes.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return kept
    twice = written(repeated.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "repeated")
    same = (kept["doc_id"] == twice["__id"]) & (_text_hash() == twice["__hash"])
    once = kept.join(twice, same, "left_semi").withColumn("__hash", _text_hash()).dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return kept.join(twice, same, "left_anti").unionByName(once)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; the others stay as they are."""
    found = decontamination.find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return _without(docs, written(found.filter("contaminated").select("doc_id", "text_hash"), "contaminated", small=True))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets and sets n_chars anew; every document stays."""
    return secrets_scan.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents."""
    return packing.pack(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the tagger or the packing; tests/llm/test_pipeline.py checks each stage's decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
