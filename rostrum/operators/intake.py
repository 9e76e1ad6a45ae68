"""Upload validation, job messages, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rostrum.functions.jsontext import strict_json
from rostrum.functions.names import iso_utc
from rostrum.limits import MAX_DURATION_SECONDS, MAX_UPLOAD_BYTES, NO_SESSION_JOB
from rostrum.schemas import JOB_MESSAGE, METADATA


def is_present(value: Column) -> Column:
    """A required field: null and the empty string count as missing."""
    return F.coalesce(value, F.lit("")) != ""


def client_job(job: Column) -> Column:
    """Meeting key a chat client sends; one without a session sends the default."""
    return F.when(is_present(job), job).otherwise(NO_SESSION_JOB)


def has_duration(duration: Column) -> Column:
    """Null, NaN and zero all mean that the probe found no duration."""
    return (F.coalesce(duration, F.lit(0.0)) != 0) & ~F.coalesce(F.isnan(duration), F.lit(False))


def reject_reason() -> Column:
    """First failed check of an upload, or null when it is accepted."""
    return (
        F.when(F.col("size_bytes") > MAX_UPLOAD_BYTES, "file_too_large")
        .when(F.col("file_name").isNull(), "no_audio_file")
        .when(~is_present(F.col("job_id")), "no_session")
        .when(~F.coalesce(F.col("metadata_ok"), F.lit(False)), "unreadable_metadata")
        .when(~has_duration(F.col("duration_s")), "no_duration")
        .when(F.col("duration_s") > MAX_DURATION_SECONDS, "too_long")
    )


def validate_uploads(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn("reject_reason", reject_reason())


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNull()).drop("reject_reason")


def dead_letters(validated: DataFrame, failed: Column) -> DataFrame:
    """Rejected uploads, and accepted ones whose processing failed."""
    reason = F.coalesce(
        F.col("reject_reason"), F.when(failed, F.lit("transcription_failed"))
    )
    return validated.withColumn("reject_reason", reason).where(reason.isNotNull())


def retry(dead: DataFrame, fresh: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work still to do: dead letters and new input, minus what was accepted."""
    columns = fresh.columns
    again = dead.select(*columns).unionByName(fresh).dropDuplicates([key])
    return again.join(done.select(key), key, "left_anti")


def job_message() -> Column:
    """The queue message of an accepted upload, as JSON."""
    return F.to_json(
        F.struct(
            F.col("job_id").alias("jobId"),
            F.col("file_id").alias("fileId"),
            F.struct(
                F.col("file_name").alias("originalFileName"),
                F.col("mimetype").alias("mimetype"),
                F.col("format_names").alias("formatNames"),
                F.col("size_bytes").alias("size"),
                F.col("duration_s").alias("duration"),
                iso_utc(F.col("ts")).alias("uploadTimestamp"),
            ).alias("metadata"),
        )
    )


def decode_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``job_id, file_id, metadata, decoded``; no metadata becomes an empty struct."""
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in METADATA.fields])
    return (
        messages.withColumn("_m", strict_json(F.col(value), JOB_MESSAGE))
        .withColumn("decoded", F.col("_m").isNotNull())
        .withColumn("job_id", F.col("_m.jobId"))
        .withColumn("file_id", F.col("_m.fileId"))
        .withColumn("metadata", F.coalesce("_m.metadata", empty))
        .drop("_m")
    )
