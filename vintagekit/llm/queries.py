"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagekit.llm import (
    audio, langid, licenses, mixing, packing, quality, recurrent, search, simhash, suffix, toxicity,
    trie, windows,
)
from vintagekit.llm.common import documents, fold


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(documents(spark, sf_dir))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    scored = recurrent.language_model_scores(documents(spark, sf_dir), fold("doc_id", 7) != 2)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    return langid.predict(docs, model).withColumn(
        "held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.passage_rows(suffix.repeated_passages(documents(spark, sf_dir)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    model = toxicity.fit(toxicity.labelled_sample(docs, labels), rows=None)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are played; excerpts of every twentieth one are looked up among all, copies as one class."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = audio.fingerprints(
        vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", audio.excerpt)
    prints = audio.fingerprints(vectors, "vec_id", "embedding", audio.melody)
    return audio.align_with_members(asked, prints, "vec_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_digest(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_index(documents(spark, sf_dir))
    return search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_lm_scoring, op2_simhash_near_dedup, op3_language_id, op4_suffix_array_dedup, op5_mixing,
        op6_quality_rules, op7_packing, op8_license_scans, op9_toxicity,
        op10_media_columns, op11_prefix_trie, op12_substring_dedup, op13_lexical_search)
}
SQL: dict[str, str] = {
    "op6_quality_rules": quality.SQL,
    "op8_license_scans": licenses.SQL,
    "op11_prefix_trie": trie.SQL,
    "op12_substring_dedup": windows.SQL,
    "op13_lexical_search": search.SQL,
}
