"""Queries op1_ to op13_, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import anchors, bpe, idstore, lattice, manifest, media, mixing, probminhash, quality, rankmerge, rules, suffixes, warc

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_read(spark, sf_dir, "documents"))


def op2_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.store(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op3_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.sniff(media.stored(media.store(_read(spark, sf_dir, "documents")))))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op6_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scores(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = rules.fit(docs, _read(spark, sf_dir, "labels"))
    return rules.scored(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.coded(_read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_read(spark, sf_dir, "documents"))


def op13_rank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankmerge.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality.ORACLE, "op8_mix_sources": mixing.ORACLE, "op11_vector_codes": anchors.ORACLE, "op12_merkle_manifest": manifest.ORACLE}
