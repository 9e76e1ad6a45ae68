"""Answers rebuilt from logged stream frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rostrum.functions.binding import let
from rostrum.functions.jsontext import strict_json
from rostrum.schemas import FRAME

PREFIX = "data: "


def frame_body() -> Column:
    """The line without surrounding space and without the ``data: `` prefix."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    return F.when(line.startswith(PREFIX), F.substr(line, F.lit(len(PREFIX) + 1))).otherwise(line)


def frame_text() -> Column:
    """Text the line carries; null for heartbeats, broken lines and empty texts."""
    return let(
        strict_json(frame_body(), FRAME),
        lambda f: F.when(f["text"] != "", f["text"]),
    )


def ends_answer() -> Column:
    body = frame_body()
    event = strict_json(body, FRAME)["event"]
    return (body == "[DONE]") | F.coalesce(event == "stream_end", F.lit(False))


def rebuild_answers(frames: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """``keys, text``: the texts before the first end frame, in order, one row an answer.

    The log is read once: end and texts come from one grouping. An answer is as
    long as its model may speak, so it fits a row whatever the log holds beside it.
    """
    # Cheap tests on the raw line first: only lines that may matter are parsed.
    # A JSON escape could hide the name of the event.
    may_end = (
        F.col("line").contains("stream_end") | F.col("line").contains("[DONE]")
        | F.col("line").contains("\\u")
    )
    # collect_list leaves out the nulls of lines without a text.
    said = let(
        frame_text(), lambda t: F.when(t.isNotNull(), F.struct(F.col(seq).alias("s"), t.alias("t")))
    )
    heard = F.filter("_said", lambda x: F.col("_end").isNull() | (x["s"] < F.col("_end")))
    return (
        frames.where(F.col("line").contains("{") | may_end)
        .groupBy(*keys)
        .agg(F.min(F.when(may_end & ends_answer(), F.col(seq))).alias("_end"),
             F.array_sort(F.collect_list(said)).alias("_said"))
        .select(*keys, heard.alias("_said"))
        .where(F.size("_said") > 0)
        .select(*keys, F.array_join(F.transform("_said", lambda x: x["t"]), "").alias("text"))
    )
