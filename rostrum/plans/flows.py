"""Whole paths through the operators: recordings to searchable points, prompts to contexts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from rostrum.functions.text import is_blank
from rostrum.limits import CHAT_HITS, TRANSCRIPT_HITS
from rostrum.operators import attempts, chats, chunks, context, lifecycle, retrieval, vector_table


class RecordingTables(NamedTuple):
    """What becomes of transcribed slices: stored text, and points to search."""

    fragments: DataFrame
    points: DataFrame


class CleanedTables(NamedTuple):
    """What becomes of a cleaner's responses: points, chunks that broke a rule, failures."""

    points: DataFrame
    rejected: DataFrame
    dead: DataFrame


RECORDING = ["job_id", "event_id", "ts", "file_name"]


def _points(cut: DataFrame) -> DataFrame:
    """Points of chunk rows that carry their recording's columns.

    A chunk without a letter has an empty vector; it is text, but no point.
    """
    points = chunks.features(vector_table.transcript_points(cut.select(
        "job_id", F.col("event_id").alias("source_id"), "chunk_idx",
        "text", "summary", F.col("file_name").alias("original_file_name"),
        "ts", F.col("event_id").alias("seq"),
    )))
    return points.where(F.size("vector") > 0)


def store_recordings(timely: DataFrame) -> RecordingTables:
    """``event_id, job_id, ts, text, file_name`` of slices that were not late.

    Text is stored as it was heard; points come from its chunks.
    """
    heard = timely.where(~is_blank(F.col("text")))
    cut = chunks.summarised(chunks.chunked(heard, RECORDING))
    return RecordingTables(heard.select("job_id", "ts", "event_id", "text"), _points(cut))


def store_cleaned(responses: DataFrame, recordings: DataFrame) -> CleanedTables:
    """The same from a cleaner's responses ``job_id, event_id, attempt, response``.

    The first valid attempt counts. Its chunks are held to the contract, which
    chunks made here meet by construction; a recording without a valid attempt
    is dead, its text stored but not searchable.
    """
    keys = ["job_id", "event_id"]
    resolved = attempts.resolve_cleaning(responses, keys)
    cut = attempts.cleaned_chunks(resolved, keys).withColumnRenamed("refined_text", "text")
    held = chunks.checked(cut)
    good = held.where(F.col("reject_reason").isNull()).join(recordings.select(*RECORDING), keys)
    return CleanedTables(
        _points(good),
        held.where(F.col("reject_reason").isNotNull()).select(*keys, "chunk_idx", "reject_reason"),
        resolved.where(F.col("outcome") == "dead").select(*keys),
    )


def recordings_to_tables(events: DataFrame, grace: str = "0 seconds") -> RecordingTables:
    """From ``event_id, job_id, ts, kind, text, file_name`` of whole meetings."""
    stops = lifecycle.stop_times(events)
    slices = events.where(F.col("kind") == "slice").drop("kind")
    return store_recordings(lifecycle.drop_late(slices, stops, grace))


def prompt_contexts(
    prompts: DataFrame, snippets: DataFrame, pairs: DataFrame, *, job: str, prompt_id: str,
    question: str, snippet_id: str, chat_id: str, before: bool = True,
    snippet_hits: int = TRANSCRIPT_HITS, chat_hits: int = CHAT_HITS,
) -> DataFrame:
    """``job, prompt_id, context`` for every prompt.

    ``snippets`` hold ``text``, ``pairs`` hold ``user_chat`` and ``ai_chat``.
    With ``before`` the ids are also the order, and a prompt only sees what
    came earlier.
    """
    asked = chunks.features(prompts, question)
    keys = [job, prompt_id]

    def hits(candidates: DataFrame, ident: str, k: int) -> DataFrame:
        found = retrieval.top_similar(
            asked, candidates, k, job=job, prompt_id=prompt_id, candidate_id=ident,
            prompt_order=prompt_id if before else None, candidate_order=ident if before else None,
        )
        return found.withColumnsRenamed({"prompt_id": prompt_id, "candidate_id": ident})

    said = context.joined_hits(
        hits(chunks.features(snippets), snippet_id, snippet_hits)
        .join(snippets.select(job, snippet_id, "text"), [job, snippet_id]),
        keys, context.snippet_line(F.col("text")), "snippets",
    )
    talked = context.joined_hits(
        hits(chats.chat_vectors(pairs), chat_id, chat_hits)
        .join(pairs.select(job, chat_id, "user_chat", "ai_chat"), [job, chat_id]),
        keys, context.chat_lines(F.col("user_chat"), F.col("ai_chat")), "chats",
    )
    return context.prompt_context(prompts, said, talked, keys, question)
