"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskveil.llm import (
    alignment, attribution, bpe, disclosure, licences, maxent, mixing, negatives, neighbours, pages, quality, simhash, toxicity,
)
from duskveil.llm.sql import SQL  # noqa: F401  (read beside QUERIES)

#: The rank file; a parameter of the operators, never copied.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: The two vocabularies that are aligned.
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(_read(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_read(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_personal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.personal_spans(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"
    )


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(_read(spark, sf_dir, "documents"), RANKS, PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_sentences", "offending")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents")).drop("matches")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), RANKS, PATTERN)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(_read(spark, sf_dir, "documents"), BYTES, PIECES, PATTERN)
    return aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    embeddings = _read(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(embeddings, F.col("vec_id") % 50 == 0)


def op13_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_lines,
        op2_main_text,
        op3_mix_sources,
        op4_simhash_components,
        op5_personal_spans,
        op6_section_tokens,
        op7_toxicity,
        op8_nearest_vectors,
        op9_licence_scan,
        op10_byte_bpe,
        op11_token_alignment,
        op12_hard_negatives,
        op13_maxent_scores,
    )
}
