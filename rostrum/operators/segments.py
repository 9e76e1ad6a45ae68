"""Fixed slices and pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rostrum.functions.names import epoch_micros, micros_to_ntz
from rostrum.limits import SLICE


def tumbling_counts(events: DataFrame, job: str, ts: str = "ts", width: str = SLICE) -> DataFrame:
    return (
        events.groupBy(F.window(ts, width).alias("_w"), job)
        .agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("window_start"), job, "n")
    )


def event_spans(events: DataFrame, job: str, gap: int, ts: str = "ts") -> DataFrame:
    """Events counted per bucket as wide as the gap: ``job, lo, hi, n``, in microseconds.

    Two events in one bucket can never be parted by a pause, so what follows runs over
    buckets, of which a meeting has as many as the calendar allows, not as many as it has
    events. They are counted on the map side too.
    """
    at = epoch_micros(F.col(ts))
    return (
        events.where(F.col(ts).isNotNull())
        .select(job, at.alias("_t"), F.floor(at / F.lit(gap)).alias("_b"))
        .groupBy(job, "_b")
        .agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.count("*").alias("n"))
        .drop("_b")
    )


def numbered_runs(spans: DataFrame, job: str, gap: int) -> DataFrame:
    """Adds ``run``: spans of a meeting that touch, or lie no more than the gap apart, share one.

    Spans may overlap; one that starts within the gap of all that came before joins them.
    """
    order = Window.partitionBy(job).orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens: Column = F.coalesce((F.col("lo") - reached > gap).cast("int"), F.lit(1))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spans.withColumn("_open", opens).withColumn("run", F.sum("_open").over(running)).drop("_open")


def runs(numbered: DataFrame, job: str) -> DataFrame:
    """One span per run: ``job, lo, hi, n``."""
    return numbered.groupBy(job, "run").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")
    ).drop("run")


def as_segments(spans: DataFrame, job: str, gap: int) -> DataFrame:
    return spans.select(
        job,
        micros_to_ntz(F.col("lo")).alias("segment_start"),
        micros_to_ntz(F.col("hi") + gap).alias("segment_end"),
        "n",
    )


def pause_segments(events: DataFrame, job: str, gap_seconds: int, ts: str = "ts") -> DataFrame:
    """Activity of a meeting cut where nothing happens for longer than the gap.

    ``job, segment_start, segment_end, n``; the end is the last event plus the
    gap, and two events exactly one gap apart share a segment.
    """
    gap = gap_seconds * 1_000_000
    spans = event_spans(events, job, gap, ts)
    return as_segments(runs(numbered_runs(spans, job, gap), job), job, gap)
