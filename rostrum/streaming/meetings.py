"""Meetings that change while they are read: lifecycle, late slices, transcripts, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from rostrum.limits import SLICE
from rostrum.operators.lifecycle import drop_late
from rostrum.plans.flows import store_recordings
from rostrum.sources.by_job import job_bucket
from rostrum.sources.sinks import (
    batch_path, each_batch, folder_exists, keep_last_folders, write_batch,
)

STATE_BUCKETS = 64


def next_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """What must be remembered of meetings: ``job_id, ts, kind``.

    ``kind`` is ``start`` for the creation, ``end`` for the first stop after it
    and ``early`` for stops up to it, which count once an earlier start or slice
    is read. Events may come in any order, and reading one twice changes nothing.
    """
    stops = F.col("kind").isin("stop", "early", "end")
    rows = state.select("job_id", "ts", "kind").unionByName(batch.select("job_id", "ts", "kind"))
    created = (
        rows.where(F.col("kind").isin("start", "slice"))
        .groupBy("job_id").agg(F.min("ts").alias("created_at"))
    )
    stopped = rows.where(stops).select("job_id", "ts").distinct().join(created, "job_id", "left")
    after = F.coalesce(F.col("ts") > F.col("created_at"), F.lit(False))
    return (
        created.select("job_id", F.col("created_at").alias("ts"), F.lit("start").alias("kind"))
        .unionByName(stopped.where(~after).select("job_id", "ts", F.lit("early").alias("kind")))
        .unionByName(
            stopped.where(after).groupBy("job_id").agg(F.min("ts").alias("ts"))
            .withColumn("kind", F.lit("end"))
        )
    )


def ends(state: DataFrame) -> DataFrame:
    """``job_id, stop_ts`` of the meetings that are over, from one or more versions of the state.

    An end only ever moves to an earlier time, so the least one is the latest.
    """
    return state.where(F.col("kind") == "end").groupBy("job_id").agg(F.min("ts").alias("stop_ts"))


def _state_table(rows: DataFrame, path: str, ts: str) -> DataFrame:
    """The stored state below ``path``, typed like ``rows``."""
    schema = T.StructType([
        rows.schema["job_id"], T.StructField("ts", rows.schema[ts].dataType),
        T.StructField("kind", T.StringType()),
        T.StructField("state_bucket", T.IntegerType()), T.StructField("version", T.LongType()),
    ])
    return rows.sparkSession.read.schema(schema).parquet(f"{path}/state")


def still_timely(
    rows: DataFrame, path: str, grace: str = "0 seconds", ts: str = "ts", spread: str = "event_id"
) -> DataFrame:
    """Stored rows of a stream without those that became late after they were stored.

    A slice that is dropped when it is read stays dropped, since ends only move
    to earlier times; with this filter the table equals the batch twin, whatever
    order the events came in.
    """
    return drop_late(rows, ends(_state_table(rows, path, ts)), grace, spread, ts=ts)


def store_slices(timely: DataFrame, path: str, batch_id: int) -> None:
    write_batch(timely, f"{path}/slices", batch_id)


def store_searchable(timely: DataFrame, path: str, batch_id: int) -> None:
    """Transcribed slices into ``slices``, then ``points``.

    The text is stored first and read back: should the rest fail, text without
    points remains, until the micro-batch runs again and replaces both.
    """
    store_slices(timely, path, batch_id)
    stored = timely.sparkSession.read.schema(timely.schema).parquet(batch_path(f"{path}/slices", batch_id))
    write_batch(store_recordings(stored).points, f"{path}/points", batch_id)


def keep_timely_slices(
    events: DataFrame, path: str, checkpoint: str, grace: str = "0 seconds", store=None
) -> StreamingQuery:
    """Slices not later than the end of their meeting, as known when they are read.

    ``events``: ``event_id, job_id, ts, kind`` and any other columns. The slices
    go to ``store(slices, path, batch_id)``, by default a table below ``path``;
    read it through ``still_timely``.

    The state of the meetings is a table in buckets. A micro-batch reads and
    writes the buckets of its own meetings and leaves the others alone. Versions
    of a bucket may lie side by side, since folding one twice changes nothing:
    a micro-batch that is run again adds the same rows again, and old versions
    are removed only when newer ones are complete.
    """
    spark = events.sparkSession
    bucket = job_bucket(F.col("job_id"), STATE_BUCKETS)
    table = f"{path}/state"

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read for its buckets, its state and its slices
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # STATE_BUCKETS at most
        if not folder_exists(spark, table):
            state = batch.select("job_id", "ts", "kind").limit(0)
        else:
            state = _state_table(batch, path, "ts").where(F.col("state_bucket").isin(touched))
        (
            next_state(state, batch)
            .withColumns({"state_bucket": bucket, "version": F.lit(batch_id).cast("bigint")})
            .hint("rebalance", F.col("state_bucket"))
            .write.mode("append").partitionBy("state_bucket", "version").parquet(table)
        )
        known = _state_table(batch, path, "ts").where(
            F.col("state_bucket").isin(touched) & (F.col("version") == batch_id)
        )
        slices = batch.where(F.col("kind") == "slice").drop("kind")
        (store or store_slices)(drop_late(slices, ends(known), grace, stored=True), path, batch_id)
        for number in touched:
            keep_last_folders(spark, f"{table}/state_bucket={number}", "version", batch_id)
        batch.unpersist()

    return each_batch(events, step, checkpoint)


def store_fragments(fragments: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Transcript fragments as an append-only table, ordered when it is read.

    Rewriting a growing document per fragment would cost more with every
    fragment; ``append_fragments`` assembles the transcript from this table.
    """
    return each_batch(fragments, lambda rows, n: write_batch(rows, path, n), checkpoint)


def running_progress(fragments: DataFrame, job: str, text: str) -> DataFrame:
    """Fragments and characters heard so far, per meeting."""
    return fragments.groupBy(job).agg(
        F.count("*").alias("n_fragments"), F.sum(F.length(text)).alias("n_chars")
    )


def keep_progress(
    fragments: DataFrame, path: str, checkpoint: str, job: str, text: str
) -> StreamingQuery:
    """Progress of the meetings a micro-batch touched, stored under its number."""
    return each_batch(
        running_progress(fragments, job, text), lambda rows, n: write_batch(rows, path, n),
        checkpoint, "update",
    )


def latest_progress(spark: SparkSession, path: str, job: str) -> DataFrame:
    """What ``keep_progress`` stored last for each meeting."""
    last = F.max_by(F.struct("n_fragments", "n_chars"), "batch_id").alias("_last")
    return spark.read.parquet(path).groupBy(job).agg(last).select(job, "_last.*")


def slice_windows(events: DataFrame, job: str, ts: str, delay: str, width: str = SLICE) -> DataFrame:
    """Events per fixed slice, emitted when the slice is over."""
    return (
        events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("_w"), job)
        .agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("window_start"), job, "n")
    )


def activity_sessions(events: DataFrame, job: str, ts: str, delay: str, gap: str) -> DataFrame:
    """Activity cut at pauses longer than ``gap``, emitted when the pause is certain."""
    return (
        events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("_w"), job)
        .agg(F.count("*").alias("n"))
        .select(job, F.col("_w.start").alias("segment_start"), F.col("_w.end").alias("segment_end"), "n")
    )
