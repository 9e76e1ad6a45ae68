"""Chat pairs, answers, history pages, chat vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rostrum.functions.vectors import hashed_features
from rostrum.limits import HISTORY_PAGE
from rostrum.operators.lookup import lookup
from rostrum.operators.ordering import ROWS_PER_TASK, with_next


def chat_pairs(
    turns: DataFrame, job: str, order: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Each user message with the answer that follows it: ``job, order, user_chat, ai_chat``.

    ``system`` turns are not part of the exchange. A message not followed by an
    answer keeps a null one.
    """
    spoken = turns.where(F.col("role") != "system").select(job, order, "role", "text")
    return (
        with_next(spoken, job, [order], ["role", "text"], rows_per_task=rows_per_task)
        .where(F.col("role") == "user")
        .select(
            job, order, F.col("text").alias("user_chat"),
            F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("ai_chat"),
        )
    )


def create_chats(prompts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """New chat rows, not answered yet."""
    return prompts.select(
        *keys, F.col(text).alias("user_chat"), F.lit(None).cast("string").alias("ai_chat")
    )


def answer_chats(
    chats: DataFrame, answers: DataFrame, keys: list[str], order: str | None = None
) -> DataFrame:
    """Chat rows with the answers of ``answers(keys, answer)`` filled in.

    A chat that is answered again keeps its last answer by ``order``; without an
    order, and among ties, the greatest one.
    """
    rank = F.struct(order, "answer") if order else F.col("answer")
    last = answers.groupBy(*keys).agg(F.max_by("answer", rank).alias("answer"))
    return chats.join(last, keys, "left").select(
        *keys, "user_chat", F.coalesce("answer", "ai_chat").alias("ai_chat")
    )


def answers_without_chat(chats: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Answers whose chat row does not exist: an error to report."""
    return answers.join(chats.select(*keys), keys, "left_anti")


def history_page(
    chats: DataFrame, job: str, job_value, order: str, ident: str,
    limit: int = HISTORY_PAGE, before=None,
) -> DataFrame:
    """Newest ``limit`` chats of one meeting before a chat id, oldest first."""
    mine = chats.where(F.col(job) == job_value)
    if before is not None:
        mine = mine.where(F.col(ident) < before)
    return mine.orderBy(F.desc(order), F.desc(ident)).limit(limit).orderBy(order, ident)


def history_pages(
    chats: DataFrame, job: str, order: str, ident: str,
    limit: int = HISTORY_PAGE, before: DataFrame | None = None,
) -> DataFrame:
    """The page of every meeting; ``pos`` counts from 1, oldest first.

    ``before(job, before_id)`` holds one cursor per meeting; a meeting without
    a row there is paged from its end. The rank limit is applied before the
    shuffle as well, so a meeting moves at most ``limit`` rows per task.
    """
    rows = chats
    if before is not None:
        rows = (
            lookup(rows, before.select(job, "before_id"), [job], ident)
            .where(F.col("before_id").isNull() | (F.col(ident) < F.col("before_id")))
            .drop("before_id")
        )
    newest = Window.partitionBy(job).orderBy(F.desc(order), F.desc(ident))
    oldest = Window.partitionBy(job).orderBy(order, ident)
    return (
        rows.withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= limit).drop("_back")
        .withColumn("pos", F.row_number().over(oldest).cast("bigint"))
    )


def combined_text(user: Column, answer: Column) -> Column:
    return F.concat(F.lit("User: "), user, F.lit("\nAI response: "), answer)


def chat_vectors(pairs: DataFrame) -> DataFrame:
    """Answered pairs with their combined text and its hashed features."""
    return (
        pairs.where(F.col("ai_chat").isNotNull())
        .withColumn("combined", combined_text(F.col("user_chat"), F.col("ai_chat")))
        .withColumn("vector", hashed_features(F.col("combined")))
    )


def vector_orphans(chats: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors without a chat (``orphan``) and chats without a vector (``unembedded``)."""
    mark = lambda df, kind: df.select(*keys, F.lit(kind).alias("kind"))
    return mark(vectors.join(chats.select(*keys), keys, "left_anti"), "orphan").unionByName(
        mark(chats.join(vectors.select(*keys), keys, "left_anti"), "unembedded")
    )
