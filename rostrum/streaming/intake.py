"""Streaming intake: accept uploads, consume messages, drop redeliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from rostrum.operators import intake
from rostrum.sources.sinks import append_files, each_batch, write_batch


def accept_uploads(uploads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Valid uploads as JSON messages, one per line, in a durable folder.

    ``uploads`` also carries the message columns ``file_id, mimetype,
    format_names``.
    """
    valid = intake.accepted(intake.validate_uploads(uploads))
    return append_files(valid.select(intake.job_message().alias("value")), path, checkpoint, "text")


def consume_messages(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Decode messages into ``accepted`` and ``dead`` tables below ``path``.

    Both are written per micro-batch, and a micro-batch that is run again
    replaces what it wrote. A message that is delivered again later is stored
    again; ``accepted_once`` reads each one once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        decoded = intake.decode_messages(batch).persist()  # read for both tables
        usable = F.col("decoded") & intake.is_present(F.col("job_id"))
        write_batch(
            decoded.where(usable).select("job_id", "file_id", "metadata"),
            f"{path}/accepted", batch_id,
        )
        write_batch(
            decoded.where(~usable).select(
                "value",
                F.when(~F.col("decoded"), "undecodable").otherwise("no_session").alias("reject_reason"),
            ),
            f"{path}/dead", batch_id,
        )
        decoded.unpersist()

    return each_batch(messages, step, checkpoint)


def accepted_once(accepted: DataFrame) -> DataFrame:
    """Stored messages without redeliveries: one per meeting and file, however late the copy."""
    return accepted.dropDuplicates(["job_id", "file_id"])


def drop_redelivered(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once, as long as its copies arrive within ``delay`` of event time.

    A copy that is late goes, and the first one that is not stays: nothing is
    dropped before the watermark has been looked at.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
