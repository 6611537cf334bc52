"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkloom.llm import encoding, extraction, jaccard, langid, linededup, lm, metric, packing, quality, vectors
from inkloom.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.top_k(table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "meta_score", "score", "accepted")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_line_dedup, op3_exact_top_k, op4_bpe, op5_quality, op6_main_text, op7_language_model, op8_near_vectors, op9_packing, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": jaccard.COMPONENTS_SQL, "op2_line_dedup": linededup.dedup_sql(), "op3_exact_top_k": metric.TOP_K_SQL, "op8_near_vectors": vectors.NEAR_SQL}
