"""Constraint report of meetings and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rostrum.limits import STATUS_DONE, STATUS_OPEN


def constraint_report(meeting_rows: DataFrame, chats: DataFrame) -> DataFrame:
    """``check_name, n_bad``: required fields, allowed status, unique meeting key."""
    allowed = F.coalesce(F.col("status").isin(STATUS_OPEN, STATUS_DONE), F.lit(False))
    per_job = meeting_rows.groupBy("job_id").agg(
        F.count("*").alias("_rows"), F.count_if(~allowed).alias("_status")
    )
    meeting_checks = per_job.agg(
        F.coalesce(F.sum(F.when(F.col("job_id").isNull(), F.col("_rows"))), F.lit(0)).alias("meeting_job_missing"),
        F.coalesce(F.sum("_status"), F.lit(0)).alias("meeting_status_invalid"),
        F.count_if(F.col("job_id").isNotNull() & (F.col("_rows") > 1)).alias("meeting_job_repeated"),
    )
    chat_checks = chats.agg(
        F.count_if(F.col("job_id").isNull()).alias("chat_job_missing"),
        F.count_if(F.coalesce("user_chat", F.lit("")) == "").alias("chat_text_missing"),
    )
    tall = lambda df: df.unpivot([], df.columns, "check_name", "n_bad")
    return tall(meeting_checks).unionByName(tall(chat_checks))
