"""Transcripts to chunk rows, and reports on them. Nothing here shuffles text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rostrum.functions.text import (
    chunk_fault, first_sentence, pack_by_pointers, pack_chunks, refine_lines,
)
from rostrum.functions.vectors import feature_norm, hashed_features
from rostrum.limits import CHUNK_WORDS, TYPICAL_CHUNKS


def refined(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``lines``, the refined dialogue lines."""
    return docs.withColumn("lines", refine_lines(F.col(text)))


def chunked(docs: DataFrame, keys: list[str], text: str = "text",
            limit: int = CHUNK_WORDS, pack=pack_chunks) -> DataFrame:
    """``keys, chunk_idx, words, text``: one row per chunk.

    ``pack`` is ``pack_chunks`` or, for long texts, ``pack_by_pointers``; both give the same.

    The outer form of the generator is used because the plain one makes Spark
    filter on the size of the array below it, which packs every text twice.
    """
    packed = pack(refine_lines(F.col(text)), limit)
    rows = docs.select(*keys, F.posexplode_outer(packed).alias("chunk_idx", "_chunk"))
    return rows.where(F.col("chunk_idx").isNotNull()).select(
        *keys,
        F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        F.col("_chunk.words").cast("bigint").alias("words"),
        F.col("_chunk.text").alias("text"),
    )


def chunked_long(docs: DataFrame, keys: list[str], text: str = "text",
                 limit: int = CHUNK_WORDS) -> DataFrame:
    """``chunked`` in a time that grows with the text, not with its square."""
    return chunked(docs, keys, text, limit, pack_by_pointers)


def summarised(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("summary", first_sentence(F.col("text")))


def checked(chunks: DataFrame, limit: int = CHUNK_WORDS) -> DataFrame:
    """Adds ``reject_reason`` by the chunk contract, from ``summary`` and ``text``."""
    return chunks.withColumn(
        "reject_reason", chunk_fault(F.col("summary"), F.col("text"), limit)
    )


def chunk_profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """How many transcripts have how many chunks, and whether that is typical."""
    low, high = TYPICAL_CHUNKS
    return (
        docs.select(F.size(pack_chunks(refine_lines(F.col(text)))).cast("bigint").alias("n_chunks"))
        .groupBy("n_chunks").agg(F.count("*").alias("n_docs"))
        .withColumn("typical", F.col("n_chunks").between(low, high))
    )


def job_counts(docs: DataFrame, job: str, text: str = "text") -> DataFrame:
    """Per meeting: chunks produced, vectors stored, characters transcribed."""
    return (
        docs.select(
            job, F.length(text).cast("bigint").alias("_chars"),
            pack_chunks(refine_lines(F.col(text))).alias("_packed"),
        )
        .select(
            job, "_chars", F.size("_packed").cast("bigint").alias("_chunks"),
            F.size(F.filter("_packed", lambda c: c["text"].rlike(r"\p{L}")))
            .cast("bigint").alias("_vectors"),
        )
        .groupBy(job).agg(
            F.sum("_chunks").alias("n_chunks"), F.sum("_vectors").alias("n_vectors"),
            F.sum("_chars").alias("n_chars"),
        )
    )


def features(df: DataFrame, text: str = "text", name: str = "vector") -> DataFrame:
    """Adds sparse hashed features of a text."""
    return df.withColumn(name, hashed_features(F.col(text)))


def feature_rows(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """``keys, bucket, weight``: the non-zero items of each unit vector."""
    return (
        df.select(*keys, vector, feature_norm(F.col(vector)).alias("_norm"))
        .select(*keys, "_norm", F.explode_outer(vector).alias("_f"))
        .where(F.col("_f").isNotNull())
        .select(
            *keys, F.col("_f.bucket").cast("bigint").alias("bucket"),
            (F.col("_f.tf") / F.col("_norm")).alias("weight"),
        )
    )
