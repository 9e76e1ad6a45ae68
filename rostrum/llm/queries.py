"""Queries of the numbered operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rostrum.llm import (
    ball_codes, cover_tree, hash_index, jaccard_join, language_id, line_dedup, mixing, packing, preference_chat,
    token_counts, token_spans, toxicity, transport_stream,
)
from rostrum.llm.common import documents
from rostrum.sources.tables import read_table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(documents(spark, sf_dir))


def op2_hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_index.nearest(read_table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = transport_stream.streams(documents(spark, sf_dir))
    return transport_stream.digests(transport_stream.read_back(stored))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = preference_chat.conversations(read_table(spark, sf_dir, "conversations"))
    rows = preference_chat.formatted(preference_chat.forked_pairs(chats))
    return rows.withColumns({c: preference_chat.spans_text(c)
                             for c in ("chosen_spans", "rejected_spans")})


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.compressed(read_table(spark, sf_dir, "embeddings"))


def op13_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.aligned(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_hash_index, op3_language_id, op4_packing, op5_mixing,
        op6_transport_stream, op7_toxicity, op8_line_dedup, op9_token_counts,
        op10_preference_chat, op11_cover_tree, op12_ball_codes, op13_token_spans,
    )
}

ORACLES: dict[str, str] = {
    "op10_preference_chat": preference_chat.ORACLE_SQL,
    "op11_cover_tree": cover_tree.ORACLE_SQL,
    "op12_ball_codes": ball_codes.oracle_sql(),
}
