"""Transcript assembly and recording progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rostrum.functions.text import is_blank
from rostrum.limits import NO_TRANSCRIPT
from rostrum.operators.ordering import ROWS_PER_TASK, number_rows


def number_chunks(
    slices: DataFrame, job: str, order: list[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Adds ``chunk_no``, counting a session's slices from 1."""
    return number_rows(slices, job, order, "chunk_no", rows_per_task)


def append_fragments(
    fragments: DataFrame, job: str, order: list[str], text: str = "text",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Ordered text fragments: ``job, chunk_no, text``, counted from 1 per meeting.

    Blank fragments are not appended. A fragment is a row however long its
    meeting is, so no row grows with a meeting; ``transcript_of`` makes the
    text of one.
    """
    spoken = fragments.where(~is_blank(F.col(text))).select(job, *order, text)
    numbered = number_rows(spoken, job, order, "chunk_no", rows_per_task, counted=fragments)
    return numbered.select(job, "chunk_no", F.col(text).alias("text"))


def full_transcripts(
    jobs: DataFrame, fragments: DataFrame, job: str, order: list[str], text: str = "text",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every meeting's fragments in order, or the default sentence as number 0.

    ``job, chunk_no, text``. Meetings without text are found by an anti join on
    keys, so the text itself is not shuffled again.
    """
    spoken = append_fragments(fragments, job, order, text, rows_per_task)
    heard = fragments.where(~is_blank(F.col(text))).select(job).distinct()
    silent = jobs.select(job).distinct().join(heard, job, "left_anti").select(
        job, F.lit(0).cast("bigint").alias("chunk_no"), F.lit(NO_TRANSCRIPT).alias("text"),
    )
    return spoken.unionByName(silent)


def transcript_of(appended: DataFrame, job: str, job_value) -> DataFrame:
    """The text of one meeting, ``job, n_chunks, transcript``; no row when absent.

    Fragments are joined by one space.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    return appended.where(F.col(job) == job_value).groupBy(job).agg(
        F.count("*").alias("n_chunks"),
        F.array_join(F.transform(ordered, lambda f: f["text"]), " ").alias("transcript"),
    )


def job_progress(slices: DataFrame, job: str) -> DataFrame:
    """Slices seen, slices still pending, and whether all are done, per session."""
    done = F.coalesce(F.col("done"), F.lit(False))
    return slices.groupBy(job).agg(
        F.count("*").alias("chunks_seen"),
        F.count_if(~done).alias("pending"),
        F.bool_and(done).alias("all_done"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"),
    )
