"""File names, object ids, format lists and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CHUNK_NAME = r"^chunk_(.+)_(\d+)_(\d+)\.webm$"
RECORDING_NAME = r"^recording-(.+)\.webm$"


def format_names(names: Column) -> Column:
    """``'Mov, MP4'`` -> ``['mov', 'mp4']``; nothing known -> ``[]``."""
    parts = F.transform(
        F.split(names, ","), lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    )
    return F.when(F.coalesce(names, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def file_stem(name: Column) -> Column:
    """Last path part without its last extension; ``.webm`` stays whole."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.when(base == "..", base).otherwise(F.regexp_replace(base, r"^(.+)\.[^.]*$", "$1"))


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a UTC wall-clock time, whatever the session zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def micros_to_ntz(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with milliseconds of a UTC wall-clock time.

    Built from the time's own text: formatting it would go through the session
    zone and move times that a change of clocks skips there.
    """
    millis = F.pmod(epoch_millis(ts), F.lit(1000)).cast("string")
    return F.concat(
        F.translate(F.substring(ts.cast("string"), 1, 19), " ", "T"),
        F.lit("."), F.lpad(millis, 3, "0"), F.lit("Z"),
    )


def object_id(job: Column, ts: Column, name: Column) -> Column:
    return F.concat_ws("_", job, epoch_millis(ts).cast("string"), file_stem(name))


def chunk_name_parts(name: Column) -> dict[str, Column]:
    """Job, number and capture time of a slice's file name; null when it is not one."""
    ok = name.rlike(CHUNK_NAME)
    part = lambda i: F.when(ok, F.regexp_extract(name, CHUNK_NAME, i))
    return {
        "job_id": part(1),
        "chunk_no": part(2).try_cast("bigint"),
        "captured_at": micros_to_ntz(part(3).try_cast("bigint") * 1000),
    }


def recording_name_time(name: Column) -> Column:
    """Capture time of the single-file form ``recording-<ISO time>.webm``."""
    text = F.when(name.rlike(RECORDING_NAME), F.regexp_extract(name, RECORDING_NAME, 1))
    return F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")
