"""First valid attempt of a retried model call."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rostrum.functions.jsontext import strict_chunks
from rostrum.functions.text import is_blank
from rostrum.limits import ANSWER_ATTEMPTS, ANSWER_ERROR, CLEAN_ATTEMPTS, NO_ANSWER


def resolve_cleaning(
    attempts: DataFrame, keys: list[str], limit: int = CLEAN_ATTEMPTS
) -> DataFrame:
    """``keys, attempt, chunks, outcome`` from ``keys, attempt, response``.

    An attempt is valid when its response holds exactly one JSON array of
    chunks. Without one among the first ``limit`` the outcome is ``dead``.
    """
    tried = attempts.where(F.col("attempt") <= limit).withColumn(
        "_chunks", strict_chunks(F.col("response"))
    )
    # Null on invalid attempts; min_by skips rows whose ordering is null.
    valid_at = F.when(F.col("_chunks").isNotNull(), F.col("attempt"))
    return tried.groupBy(*keys).agg(
        F.min(valid_at).cast("bigint").alias("attempt"),
        F.min_by("_chunks", valid_at).alias("chunks"),
    ).withColumn("outcome", F.when(F.col("attempt").isNotNull(), "ok").otherwise("dead"))


def cleaned_chunks(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """One row per chunk of the resolved responses."""
    return resolved.where(F.col("outcome") == "ok").select(
        *keys, F.posexplode("chunks").alias("chunk_idx", "_chunk")
    ).select(
        *keys, F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        F.col("_chunk.summary").alias("summary"),
        F.col("_chunk.refined_text").alias("refined_text"),
    )


def resolve_answers(
    attempts: DataFrame, keys: list[str], limit: int = ANSWER_ATTEMPTS
) -> DataFrame:
    """``keys, attempt, answer`` from ``keys, attempt, response, failed``.

    Valid means not failed and not blank. Without a valid answer the apology
    depends on the last attempt: it failed, or it came back empty.
    """
    valid = ~F.col("failed") & ~is_blank(F.col("response"))
    valid_at = F.when(valid, F.col("attempt"))
    tried = attempts.where(F.col("attempt") <= limit)
    return tried.groupBy(*keys).agg(
        F.min(valid_at).cast("bigint").alias("attempt"),
        F.min_by("response", valid_at).alias("_answer"),
        F.max_by("failed", "attempt").alias("_failed"),
    ).select(
        *keys, "attempt",
        F.coalesce(
            "_answer", F.when(F.col("_failed"), ANSWER_ERROR).otherwise(NO_ANSWER)
        ).alias("answer"),
    )
