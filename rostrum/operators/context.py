"""Retrieval context of a prompt as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rostrum.functions.jsontext import json_quote
from rostrum.limits import NO_CHATS, NO_SNIPPETS

# Headings of the three sections, a fixed format.
TRANSCRIPT_HEAD = "# Meeting Transcription Context:"
CHAT_HEAD = "# Relevant Chat History:"
QUESTION_HEAD = "# User's Question:"


def snippet_line(text: Column) -> Column:
    return F.concat(F.lit("Transcription Snippet: "), text)


def chat_lines(user: Column, answer: Column) -> Column:
    return F.concat(F.lit("User: "), json_quote(user), F.lit("\nAI: "), answer)


def joined_hits(hits: DataFrame, keys: list[str], line: Column, name: str) -> DataFrame:
    """Lines of each prompt's hits in rank order; a prompt has at most k of them."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy(*keys).agg(
        F.array_join(F.transform(ranked, lambda h: h["line"]), "\n").alias(name)
    )


def prompt_context(
    prompts: DataFrame, snippets: DataFrame, chats: DataFrame, keys: list[str], question: str
) -> DataFrame:
    """``keys, context``. ``snippets`` and ``chats`` hold joined hits per prompt."""
    blank = F.lit("\n\n")
    text = F.concat(
        F.lit(TRANSCRIPT_HEAD + "\n"), F.coalesce("snippets", F.lit(NO_SNIPPETS)), blank,
        F.lit(CHAT_HEAD + "\n"), F.coalesce("chats", F.lit(NO_CHATS)), blank,
        F.lit(QUESTION_HEAD + "\n"), F.col(question),
    )
    return (
        prompts.select(*keys, question)
        .join(snippets, keys, "left").join(chats, keys, "left")
        .select(*keys, text.alias("context"))
    )
