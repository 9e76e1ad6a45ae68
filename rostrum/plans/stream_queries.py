"""Streaming jobs run over the driver's tables until all input is read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.functions.names import format_names, object_id
from rostrum.limits import PAUSE, STATUS_DONE, STATUS_OPEN
from rostrum.operators import transcript, vector_table
from rostrum.plans import fixtures as fx
from rostrum.plans.queries import PAUSE_SECONDS, point_report, query
from rostrum.schemas import EVENTS
from rostrum.session import scratch_path
from rostrum.sources.sinks import append_files, read_batches
from rostrum.sources.tables import stream_files
from rostrum.streaming import intake, keyed, ledger, meetings, sessions

DELAY = "10 minutes"
DELAY_SECONDS = 600
ANY_ORDER = "60000 days"  # a delay no event of a table exceeds
FILES_PER_STEP = 64  # bounds what one micro-batch takes in
STEPS = 4
LEDGER_BUCKETS = 16


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return stream_files(spark, f"{folder}/events*.parquet", EVENTS, files_per_step=FILES_PER_STEP)


def _message_files(spark: SparkSession) -> int:
    """Files of messages that a micro-batch takes in: one a core, so that what a micro-batch
    costs by itself, and what it looks up, isn't paid for every few files."""
    return max(spark.sparkContext.defaultParallelism, STEPS)


def _shuffled(df: DataFrame, key: str) -> DataFrame:
    """A table as a stream of ``STEPS`` micro-batches that do not follow its order."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), STEPS)
    path = scratch_path(spark, "shuffled")
    df.repartition(n, key).write.parquet(path)
    return stream_files(spark, path, df.schema, files_per_step=-(-n // STEPS))


def _settled(df: DataFrame, key: str, last: DataFrame, label: str, job) -> DataFrame:
    """What ``job`` emits for a table in ``STEPS`` micro-batches that do not follow its
    order, and then for ``last``, rows so late in time that all before them is settled."""
    spark = keyed.keyed_state(df.sparkSession)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), STEPS)
    path = scratch_path(spark, label)
    for rows in (df.repartition(n, key), last):
        rows.select(*df.columns).write.mode("append").parquet(f"{path}/in")
        stream = stream_files(spark, f"{path}/in", df.schema, files_per_step=-(-n // STEPS))
        append_files(job(stream), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def _closed(spark: SparkSession, folder: str, label: str, windows) -> DataFrame:
    """All windows over the events, the last ones too.

    A second run on the same checkpoint reads one event far in the future; the
    watermark passes every window but the one of that event.
    """
    path = scratch_path(spark, label)
    spark.createDataFrame([], EVENTS).write.parquet(f"{path}/closing")
    for closing in (False, True):
        if closing:
            last = [(None, dt.datetime(9000, 1, 1), None, None, None, None)]
            spark.createDataFrame(last, EVENTS).write.mode("append").parquet(f"{path}/closing")
        rows = _events(spark, folder).unionByName(stream_files(spark, f"{path}/closing", EVENTS))
        append_files(windows(_timed(rows)), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with a zone; the zone is the session's both ways."""
    return events.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp"), "event_type")


def _local(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


def _upload_messages(events: DataFrame) -> DataFrame:
    name = fx.file_name()
    return fx.uploads(events.withColumns({
        "file_id": object_id(F.col("user_id").cast("string"), F.col("ts"), name),
        "mimetype": F.concat(F.lit("audio/"), F.col("event_type")),
        "format_names": format_names(fx.format_text()),
    }), "file_id", "mimetype", "format_names")


def _accepted_messages(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "accepted")
    intake.accept_uploads(
        _upload_messages(_events(spark, folder)), f"{path}/messages", f"{path}/checkpoint"
    ).awaitTermination()
    return f"{path}/messages"


@query
def stream_accept(spark, folder):
    """Messages published for the valid uploads."""
    messages = spark.read.text(_accepted_messages(spark, folder))
    return messages.select(
        F.get_json_object("value", "$.jobId").alias("job_id"),
        F.get_json_object("value", "$.fileId").alias("file_id"),
    )


@query
def stream_ingest(spark, folder):
    """Published messages, each delivered twice, consumed once."""
    published = _accepted_messages(spark, folder)
    path = scratch_path(spark, "ingest")
    messages = spark.readStream.option("maxFilesPerTrigger", _message_files(spark)).text(published).withColumn(
        "value", F.explode(F.array("value", "value"))
    )
    intake.consume_messages(messages, path, f"{path}/checkpoint").awaitTermination()
    return intake.accepted_once(read_batches(spark, f"{path}/accepted")).select(
        "job_id", "file_id", F.col("metadata.originalFileName").alias("file_name"),
        F.col("metadata.size").alias("size_bytes"),
    )


@query
def stream_once(spark, folder):
    """Published messages consumed, then all of them delivered again, and refused at intake."""
    published = _accepted_messages(spark, folder)
    path = scratch_path(spark, "once")
    for copies in (2, 1):
        again = F.explode(F.array_repeat("value", copies))
        spark.read.text(published).select(again.alias("value")).write.mode("append").text(f"{path}/in")
        messages = spark.readStream.option("maxFilesPerTrigger", _message_files(spark)).text(f"{path}/in")
        ledger.consume_once(messages, path, f"{path}/checkpoint", buckets=LEDGER_BUCKETS).awaitTermination()
    return read_batches(spark, f"{path}/accepted").select(
        "job_id", "file_id", F.col("metadata.originalFileName").alias("file_name"),
        F.col("metadata.size").alias("size_bytes"))


@query
def stream_dedup(spark, folder):
    """Every event delivered twice, kept once."""
    twice = _timed(_events(spark, folder)).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    path = scratch_path(spark, "dedup")
    once = intake.drop_redelivered(twice, "event_id", "ts", DELAY).select("event_id", "job_id")
    append_files(once, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query
def stream_late_drop(spark, folder):
    """Slices in time, from events that come out of order."""
    path = scratch_path(spark, "late")
    rows = _shuffled(fx.meeting_events(fx.events(spark, folder)), "event_id")
    meetings.keep_timely_slices(rows, path, f"{path}/checkpoint").awaitTermination()
    stored = read_batches(spark, f"{path}/slices")
    return meetings.still_timely(stored, path).select("event_id", "job_id")


def _meeting_states(spark: SparkSession, folder: str) -> DataFrame:
    events = fx.meeting_events(fx.events(spark, folder))
    far = spark.createDataFrame([("end", "none", dt.datetime(2250, 1, 1))], "j string, kind string, ts timestamp")
    last = far.select(
        F.lit(None).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("job_id"),
        F.col("ts").cast(events.schema["ts"].dataType).alias("ts"), "kind")
    return _settled(events, "event_id", last, "states",
                    lambda rows: keyed.meeting_states(rows, ANY_ORDER))


@query
def stream_meeting_state(spark, folder):
    """Meetings as they were settled, from events that come out of order."""
    rows = _meeting_states(spark, folder).where("what = 'meeting'")
    return rows.select(
        F.col("job_id").cast("long").alias("job_id"), _local("created_at"), _local("stop_ts"),
        F.when(F.col("stop_ts").isNull(), STATUS_OPEN).otherwise(STATUS_DONE).alias("status"))


@query
def stream_timely_slices(spark, folder):
    """Slices decided by the state of their meeting, each once and for good."""
    rows = _meeting_states(spark, folder).where("what = 'slice'")
    return rows.select("event_id", F.col("job_id").cast("long").alias("job_id"))


@query
def stream_running_transcript(spark, folder):
    """Transcripts numbered while fragments come in out of order, late ones corrected."""
    said = fx.spoken(fx.turns(spark, folder))
    changes = _settled(said, "turn", said.limit(0), "transcripts",
                       lambda rows: keyed.running_transcript(rows, "conv_id", "turn"))
    return keyed.current_transcript(changes).select(
        F.col("job_id").cast("long").alias("conv_id"), "chunk_no", F.md5("text").alias("text_md5"))


@query
def stream_recordings(spark, folder):
    """The stored points of recordings that arrived as a stream."""
    schema = fx.documents(spark, folder).schema
    rows = fx.recordings(
        stream_files(spark, f"{folder}/documents*.parquet", schema, files_per_step=FILES_PER_STEP)
    )
    path = scratch_path(spark, "recordings")
    meetings.keep_timely_slices(
        rows, path, f"{path}/checkpoint", store=meetings.store_searchable
    ).awaitTermination()
    stored = vector_table.latest_points(read_batches(spark, f"{path}/points"))
    return point_report(meetings.still_timely(stored, path, ts="upload_timestamp", spread="id"))


@query
def running_progress(spark, folder):
    """What has been heard of every conversation, kept while fragments come in."""
    rows = _shuffled(fx.spoken(fx.turns(spark, folder)), "turn")
    path = scratch_path(spark, "progress")
    meetings.keep_progress(rows, f"{path}/rows", f"{path}/checkpoint", "conv_id", "text").awaitTermination()
    return meetings.latest_progress(spark, f"{path}/rows", "conv_id")


@query
def stream_transcript(spark, folder):
    """Transcripts assembled from fragments that arrived as a stream."""
    schema = fx.turns(spark, folder).schema
    rows = stream_files(spark, f"{folder}/conversations*.parquet", schema, files_per_step=FILES_PER_STEP)
    path = scratch_path(spark, "fragments")
    meetings.store_fragments(fx.spoken(rows), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    stored = read_batches(spark, f"{path}/rows")
    return transcript.append_fragments(stored, "conv_id", ["turn"]).select(
        "conv_id", "chunk_no", F.md5("text").alias("text_md5")
    )


@query
def stream_slices(spark, folder):
    """Ten-minute counts of all slices."""
    rows = _closed(spark, folder, "slices", lambda e: meetings.slice_windows(e, "job_id", "ts", DELAY))
    return rows.select(_local("window_start"), "job_id", "n")


@query
def stream_sessions(spark, folder):
    """Activity between pauses."""
    rows = _closed(
        spark, folder, "sessions",
        lambda e: meetings.activity_sessions(e, "job_id", "ts", DELAY, PAUSE),
    )
    return rows.select(
        "job_id", _local("segment_start"), _local("segment_end"), "n"
    )


@query
def stream_sessions_corrected(spark, folder):
    """Activity between pauses, from events that come out of order and mostly too late."""
    events = fx.events(spark, folder).select("event_id", F.col("user_id").alias("job_id"), "ts")
    path = scratch_path(spark, "corrected")
    run, kept = sessions.keep_sessions(
        _shuffled(events, "event_id"), path, f"{path}/checkpoint", "job_id", "ts", PAUSE_SECONDS, DELAY_SECONDS)
    run.awaitTermination()
    return kept.current(spark)
