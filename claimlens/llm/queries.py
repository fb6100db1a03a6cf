"""Registered queries of this folder: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import ann, decontamination, divergence, extraction, langid, lm, packing, resampling, secrets_scan, sharding, simhash, toxicity, variants
from claimlens.llm.common import held_out, read_table

#: Byte limit of a shard in op10: small files for a random-access training loader.
SHARD_BYTES = 1 << 20


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_hash", "class_root")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = held_out("doc_id", 10, 0)
    scored = lm.score(read_table(spark, sf_dir, "documents"), ~apart)
    return scored.select("doc_id", apart.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ratios = resampling.log_ratios(docs, read_table(spark, sf_dir, "labels"), F.col("quality") == 1)
    return resampling.resample(docs, ratios, KEPT_SHARE)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = read_table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    return langid.predict(docs, langid.train(docs, ~apart)).select(
        "doc_id", apart.alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = read_table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~apart)
    return toxicity.score(docs, model).select(
        "doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    found = secrets_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        count("entropy").alias("n_entropy"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op10_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), "doc_id", "text", SHARD_BYTES)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"), top=200)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.count_words(read_table(spark, sf_dir, "documents")))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.train(pages))


#: The vocabulary of byte_bpe_50k.json as ranks; the library that reads it is several times faster.
RANKS = "byte_bpe_50k.tiktoken"

#: Share of the documents that op4 samples.
KEPT_SHARE = 0.8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_language_model": op3_language_model,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_extendible_sharding": op10_extendible_sharding,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_html_extraction": op13_html_extraction,
}
