"""Meetings: creation, status, and what arrives after the end.

Input is a table of meeting events ``job_id, ts, kind`` with kind ``start``,
``slice`` or ``stop``. A meeting exists from its first start or slice; only a
stop after that counts; once completed it stays so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rostrum.limits import STATUS_DONE, STATUS_OPEN
from rostrum.operators.lookup import lookup


def meetings(events: DataFrame) -> DataFrame:
    """``job_id, created_at, status``.

    One aggregation with map-side combine: some stop follows the creation
    exactly when the last stop does.
    """
    opened = F.min(F.when(F.col("kind").isin("start", "slice"), F.col("ts")))
    last_stop = F.max(F.when(F.col("kind") == "stop", F.col("ts")))
    return (
        events.groupBy("job_id")
        .agg(opened.alias("created_at"), last_stop.alias("_last_stop"))
        .where(F.col("created_at").isNotNull())
        .select(
            "job_id", "created_at",
            F.when(F.col("_last_stop") > F.col("created_at"), STATUS_DONE)
            .otherwise(STATUS_OPEN).alias("status"),
        )
    )


def stop_times(events: DataFrame) -> DataFrame:
    """``job_id, stop_ts``: the first stop after the creation, completed meetings only.

    Each task keeps one minimum per meeting before the stops are brought
    together, so a meeting with a large part of all stops is no burden.
    """
    opened = (
        events.where(F.col("kind").isin("start", "slice"))
        .groupBy("job_id").agg(F.min("ts").alias("created_at"))
    )
    stops = events.where(F.col("kind") == "stop").select("job_id", "ts")
    return (
        lookup(stops, opened, ["job_id"], "ts", "inner")
        .where(F.col("ts") > F.col("created_at"))
        .groupBy("job_id").agg(F.min("ts").alias("stop_ts"))
    )


def with_status(jobs: DataFrame, meeting_rows: DataFrame, spread: str = "event_id", **limits: int) -> DataFrame:
    """Adds the meeting's status; a meeting that is not there gives null.

    Beyond the broadcast, each hot meeting gets salts by its share; ``limits`` go to ``lookup``.
    """
    return lookup(jobs, meeting_rows.select("job_id", "status"), ["job_id"], spread, salts=None, **limits)


def drop_completed(jobs: DataFrame, meeting_rows: DataFrame, spread: str = "event_id") -> DataFrame:
    """Jobs whose meeting is not completed, by its final status."""
    done = meeting_rows.where(F.col("status") == STATUS_DONE).select("job_id")
    return lookup(jobs, done, ["job_id"], spread, "left_anti")


def drop_late(
    slices: DataFrame, stops: DataFrame, grace: str = "0 seconds", spread: str = "event_id",
    stored: bool = False, ts: str = "ts",
) -> DataFrame:
    """Slices taken no later than their meeting's end, plus ``grace``.

    ``stored`` says that ``stops`` is read from a table already.
    """
    limit = F.col("stop_ts") + F.expr(f"interval {grace}")
    return (
        lookup(slices, stops, ["job_id"], spread, stored=stored)
        .where(F.col("stop_ts").isNull() | (F.col(ts) <= limit))
        .drop("stop_ts")
    )
