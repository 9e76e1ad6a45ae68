"""The driver's tables read as uploads, meeting events, turns, frames and attempts.

Defects are derived from the data itself (cents of ``value``, text lengths,
turn numbers), over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rostrum.functions.jsontext import json_quote
from rostrum.functions.names import epoch_millis, format_names, iso_utc, object_id
from rostrum.sources.tables import read_table, spread

SLICE_TYPES = ("click", "view", "error")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events")


def defect() -> Column:
    """The cents of ``value``, 0 to 99: which defect an upload has, if any."""
    return F.round(F.col("value") * 100).cast("bigint") % 100


def props_key() -> Column:
    return F.get_json_object("props", "$.k").try_cast("bigint")


def kind() -> Column:
    """Role of an event in its meeting; null when it has none."""
    stop = (F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0)
    return (
        F.when(F.col("event_type") == "signup", "start")
        .when(stop, "stop")
        .when(F.col("event_type").isin("click", "view"), "slice")
    )


def meeting_events(ev: DataFrame) -> DataFrame:
    roles = ev.where(F.col("event_type").isin("signup", "click", "view", "purchase"))
    return roles.select(
        "event_id", F.col("user_id").alias("job_id"), "ts", kind().alias("kind")
    ).where(F.col("kind").isNotNull())


def manifest(ev: DataFrame) -> DataFrame:
    """Every recorded slice, failed ones included."""
    return ev.where(F.col("event_type").isin(*SLICE_TYPES)).select(
        "event_id", F.col("user_id").alias("job_id"), "ts",
        (F.col("value") * 131072).cast("bigint").alias("size_bytes"),
        (F.col("value") * 4).alias("duration_s"),
        (F.col("event_type") == "error").alias("failed"),
    )


def slices(ev: DataFrame) -> DataFrame:
    return manifest(ev).where(~F.col("failed")).select("event_id", "job_id", "ts")


def file_name() -> Column:
    job, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    return (
        F.when(
            F.col("event_type") == "click",
            F.concat(F.lit("chunk_"), job, F.lit("_"), event, F.lit("_"),
                     epoch_millis(F.col("ts")).cast("string"), F.lit(".webm")),
        )
        .when(F.col("event_type") == "view", F.concat(F.lit("audio/"), event, F.lit(".part.mp3")))
        .when(F.col("event_type") == "signup", F.lit(".webm"))
        .otherwise(F.concat(F.lit("recording-"), iso_utc(F.col("ts")), F.lit(".webm")))
    )


def format_text() -> Column:
    return (
        F.when(F.col("event_type") == "click", "matroska, WebM")
        .when(F.col("event_type") == "view", "mov,mp4,m4a, 3GP ")
        .when(F.col("event_type") == "signup", "")
    )


def uploads(ev: DataFrame, *extra: str) -> DataFrame:
    """Slices as uploads, about one in twenty defective; keeps ``extra`` columns."""
    k = defect()
    base = ev.where(F.col("event_type").isin(*SLICE_TYPES))
    return base.select(
        "event_id", "ts",
        F.when(k == 1, "").when(k == 2, None).otherwise(F.col("user_id").cast("string")).alias("job_id"),
        F.when(k == 0, None).otherwise(file_name()).alias("file_name"),
        F.when(k == 0, None).otherwise((F.col("value") * 131072).cast("bigint")).alias("size_bytes"),
        (k != 3).alias("metadata_ok"),
        F.when(k == 4, None).when(k == 5, 0.0).when(k == 6, F.col("value") * 4 + 900)
        .otherwise(F.col("value") * 4).alias("duration_s"),
        (F.col("event_type") == "error").alias("failed"), *extra,
    )


def message_fields(ev: DataFrame) -> DataFrame:
    """Columns of a queue message for every event."""
    return ev.select(
        "event_id", "event_type", "ts", "props",
        F.col("user_id").cast("string").alias("job_id"),
        file_name().alias("file_name"),
        object_id(F.col("user_id").cast("string"), F.col("ts"), file_name()).alias("file_id"),
        F.concat(F.lit("audio/"), F.col("event_type")).alias("mimetype"),
        format_names(format_text()).alias("format_names"),
        (F.col("value") * 131072).cast("bigint").alias("size_bytes"),
        F.round("value", 2).alias("duration_s"),
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "conversations")


def spread_turns(spark: SparkSession, folder: str) -> DataFrame:
    return spread(turns(spark, folder), "conv_id", "turn")


def spoken(tn: DataFrame) -> DataFrame:
    """Transcript fragments of a conversation."""
    return tn.where(F.col("role") != "system").select("conv_id", "turn", "text")


def prompts(tn: DataFrame) -> DataFrame:
    return tn.where(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("prompt_turn"), F.col("text").alias("question")
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def spread_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(documents(spark, folder), "doc_id")


def recordings(docs: DataFrame) -> DataFrame:
    """Documents as transcribed slices, one a minute; some lengths end the meeting instead."""
    return docs.select(
        F.col("doc_id").alias("event_id"), F.col("source").alias("job_id"),
        F.timestamp_add("MINUTE", F.col("doc_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("ts"),
        F.when(F.col("n_chars") % 50 == 0, "stop").otherwise("slice").alias("kind"), "text",
        F.concat(F.lit("rec-"), F.col("doc_id").cast("string"), F.lit(".webm")).alias("file_name"),
    )


def clean_attempts(tn: DataFrame) -> DataFrame:
    """Four cleaner responses per answer, valid or broken by text length."""
    item = F.concat(
        F.lit('{"summary":'), json_quote(F.col("role")),
        F.lit(',"refined_text":'), json_quote(F.concat(F.lit("- "), F.col("text"))), F.lit("}"),
    )
    case = (F.length("text") + F.col("attempt")) % 6
    response = (
        F.when(case == 0, F.concat(F.lit("```json\n["), item, F.lit("]\n```")))
        .when(case == 1, F.lit("no array here"))
        .when(case == 2, F.concat(F.lit("["), item, F.lit("] and [2]")))
        .when(case == 3, F.concat(F.lit("["), item, F.lit(",]")))
        .when(case == 4, F.lit("Sure: []"))
        .otherwise(F.concat(F.lit("["), item, F.lit(",\n"), item, F.lit("]")))
    )
    return (
        tn.where(F.col("role") == "assistant")
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(4))))
        .select("conv_id", "turn", "attempt", response.alias("response"))
    )


def answer_attempts(tn: DataFrame) -> DataFrame:
    """Three answers per prompt: blank, failed or good by text length."""
    case = (F.length("text") + 2 * F.col("attempt")) % 5
    return (
        tn.where(F.col("role") == "user")
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3))))
        .select(
            "conv_id", "turn", "attempt",
            F.when(case == 0, " \n\t").when(case.isin(1, 2), None)
            .otherwise(F.concat(F.col("attempt").cast("string"), F.lit(": "), F.col("text")))
            .alias("response"),
            (case == 1).alias("failed"),
        )
    )


def frames(tn: DataFrame) -> DataFrame:
    """Frame log of every answer: a frame per word, heartbeats, the end, a late frame."""
    words = F.split("text", " ")
    said = (
        tn.where(F.col("role") == "assistant")
        .select("conv_id", "turn", F.size(words).alias("_n"), F.posexplode(words).alias("_i", "_w"))
    )
    text_line = lambda t: F.concat(F.lit('data: {"text": '), json_quote(t), F.lit("}"))
    spoken_lines = said.select(
        "conv_id", "turn", (F.col("_i") * 2).cast("bigint").alias("seq"),
        F.concat(F.lit(" "), text_line(F.concat("_w", F.lit(" ")))).alias("line"),
    )
    beats = said.select(
        "conv_id", "turn", (F.col("_i") * 2 + 1).cast("bigint").alias("seq"),
        F.when(F.col("_i") % 3 == 0, ":heartbeat")
        .when(F.col("_i") % 3 == 1, 'data: {"text": "cut')
        .otherwise('data: {"text": ""}').alias("line"),
    )
    ends = said.where(F.col("_i") == 0).select(
        "conv_id", "turn",
        F.explode(F.array(
            F.struct((F.col("_n") * 2).cast("bigint").alias("seq"),
                     F.lit('data: {"event": "stream_end"}').alias("line")),
            F.struct((F.col("_n") * 2 + 1).cast("bigint").alias("seq"),
                     F.lit('data: {"text": "late"}').alias("line")),
        )).alias("_f"),
    ).select("conv_id", "turn", "_f.seq", "_f.line")
    return spoken_lines.unionByName(beats).unionByName(ends)
