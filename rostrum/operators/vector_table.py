"""Vector points: contract, keys, payload, idempotent upsert, storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rostrum.functions.names import iso_utc
from rostrum.functions.vectors import dense, hashed_features, l2_norm, width
from rostrum.limits import VECTOR_WIDTH
from rostrum.schemas import POINTS
from rostrum.sources.by_job import write_by_job
from rostrum.sources.snapshots import BUCKETS, last_written, merge_rows, read_snapshot

WRITTEN = ["upload_timestamp", "seq"]  # the order of writes of one point


def point_id(job: Column, source: Column, chunk_idx: Column) -> Column:
    """Same chunk, same id: a replay replaces instead of adding."""
    return F.sha2(
        F.concat_ws("|", job.cast("string"), source.cast("string"), chunk_idx.cast("string")), 256
    )


def transcript_points(chunks: DataFrame) -> DataFrame:
    """Payload of transcript chunks.

    ``chunks``: ``job_id, source_id, chunk_idx, text, summary, original_file_name, ts, seq``.
    """
    return chunks.select(
        point_id(F.col("job_id"), F.col("source_id"), F.col("chunk_idx")).alias("id"),
        "job_id", F.col("original_file_name").alias("filename"),
        F.col("ts").alias("upload_timestamp"), "text", "summary", "seq",
    )


def chat_points(pairs: DataFrame, job: str, chat: str, ts: str) -> DataFrame:
    """Payload and vector of embedded chat pairs (see ``chats.chat_vectors``)."""
    return pairs.select(
        point_id(F.col(job), F.col(chat), F.lit("chat")).alias("id"),
        F.col(job).alias("job_id"), F.col(chat).cast("string").alias("chat_id"),
        "user_chat", "ai_chat", iso_utc(F.col(ts)).alias("timestamp"), "vector",
    )


def latest_points(points: DataFrame, key: str = "id", told_by: list[str] | None = None) -> DataFrame:
    """One row per key, the last written.

    The rank limit runs before the shuffle too, so a key that was replayed many
    times moves one row per task. Writes of one time and number are told apart by what
    they hold, or by the columns in ``told_by``.
    """
    return last_written(points, key, WRITTEN, told_by)


def embed(df: DataFrame, text: str, name: str = "vector",
          fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds a vector: hashed features made dense, or what ``fn(column)`` returns.

    ``fn`` may wrap an Arrow ``pandas_udf`` returning ``array<float>``. The vector comes out
    of a generator: conditions on it are not moved below and there made from the text anew.
    """
    vector = fn(F.col(text)) if fn else dense(hashed_features(F.col(text)))
    return df.withColumn(name, F.explode(F.array(vector)))


def usable(df: DataFrame, vector: str = "vector", size: int = VECTOR_WIDTH) -> DataFrame:
    """Points that may be stored: empty vectors skipped, a wrong width is an error."""
    w = width(F.col(vector))
    # Says by itself that empty vectors pass, since filters may be reordered.
    fits = F.when(
        (w > 0) & (w != size),
        F.raise_error(F.concat(F.lit("vector width is not "), F.lit(size))).cast("boolean"),
    ).otherwise(F.lit(True))
    return df.where((w > 0) & fits)


def contract_report(df: DataFrame, job: str, vector: str, size: int) -> DataFrame:
    """Per meeting: points, empty, wrong width, without direction, and whether any is left."""
    return measured_report(measured(df, vector, size), job, size)


def measured(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Adds ``_width`` and ``_good``, all that a report needs of a vector."""
    w = width(F.col(vector))
    good = (w == size) & (F.coalesce(l2_norm(F.col(vector)), F.lit(0.0)) > 0)
    return df.withColumns({"_width": w, "_good": good})


def measured_report(df: DataFrame, job: str, size: int) -> DataFrame:
    """``contract_report`` of rows that ``measured`` gave: their vectors need not move."""
    w, good = F.col("_width"), F.col("_good")
    return df.groupBy(job).agg(
        F.count("*").alias("n"),
        F.count_if(w == 0).alias("n_empty"),
        F.count_if((w > 0) & (w != size)).alias("n_wrong_width"),
        F.count_if((w == size) & ~good).alias("n_no_direction"),
        F.count_if(good).alias("n_usable"),
        (F.count_if(w > 0) == 0).alias("none_left"),
    )


def merge_points(points: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Merge a delivery into the stored points, last write wins; the table's new version.

    Only the buckets of the delivery's points are read and written.
    """
    return merge_rows(points, path, "id", WRITTEN, buckets)


def merged_points(spark: SparkSession, path: str, version: int | None = None,
                  schema=None) -> DataFrame:
    """The points as of a version, one per key: nothing is left to be sorted out."""
    return read_snapshot(spark, path, schema or POINTS, version)


def write_points(points: DataFrame, path: str, job: str = "job_id", **options) -> None:
    """Appended, not replaced: last write wins when read through ``latest_points``."""
    write_by_job(points, path, job, **options)
