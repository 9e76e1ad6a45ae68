"""Sessions of a stream that late events correct.

A session is settled once the watermark has passed its last event by the gap; it is then
appended to ``closed`` and never looked at by timely events again, since none can lie
within the gap of it. Events behind the watermark are kept in the side table ``late``. A
micro-batch that has some reads the settled sessions they may touch, and only those are
made anew: a late event may lengthen one, bridge two, or make one of its own. What a
correction replaces is marked in ``gone``; files of settled sessions are never rewritten.

Every table is written under the number of the micro-batch, from tables of earlier ones
only: a micro-batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from rostrum.functions.names import epoch_micros
from rostrum.operators.lookup import lookup
from rostrum.operators.segments import as_segments, event_spans, numbered_runs
from rostrum.sources.sinks import batch_path, each_batch, folder_exists, keep_last_folders, write_batch

DAY = 86_400_000_000  # microseconds


def _key(*columns: str) -> Column:
    """Columns as one text that is never null."""
    return F.to_json(F.struct(*columns))


class Sessions:
    """Sessions of ``job`` cut at pauses above ``gap_seconds``, below ``path``.

    Events without time are left out; those without meeting count as one meeting. An event
    delivered twice counts twice: drop copies before (``ledger``).
    """

    def __init__(self, path: str, job: T.StructField, gap_seconds: int, delay_seconds: int) -> None:
        self.path, self.job = path, job.name
        self.gap, self.delay = gap_seconds * 1_000_000, delay_seconds * 1_000_000
        long = lambda name: T.StructField(name, T.LongType())
        self.spans = T.StructType([job, long("lo"), long("hi"), long("n")])
        self.closed_rows = T.StructType([*self.spans, long("last_day"), long("batch_id")])
        self.gone_rows = T.StructType([T.StructField("session", T.StringType()), long("batch_id")])

    def _stored(self, spark: SparkSession, name: str, schema: T.StructType, before: int | None) -> DataFrame:
        if not folder_exists(spark, f"{self.path}/{name}"):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch_id") < before)

    def _last(self, spark: SparkSession, name: str, before: int) -> int | None:
        """The newest micro-batch before ``before`` that wrote ``name``, of the two that are kept."""
        for number in (before - 1, before - 2):
            if number >= 0 and folder_exists(spark, batch_path(f"{self.path}/{name}", number)):
                return number
        return None

    def watermark(self, spark: SparkSession, before: int) -> int | None:
        last = self._last(spark, "marks", before)
        if last is None:
            return None
        return spark.read.schema("mark long").parquet(batch_path(f"{self.path}/marks", last)).first()[0]

    def settled(self, spark: SparkSession, before: int | None = None, since: int | None = None) -> DataFrame:
        """Settled sessions that no correction replaced: ``job, lo, hi, n, session``.

        ``since`` leaves out, by folders, those whose last event is of an earlier day. Marks of
        what is gone are few, so sessions are not shuffled to lose them (``lookup``).
        """
        rows = self._stored(spark, "closed", self.closed_rows, before)
        if since is not None:
            rows = rows.where(F.col("last_day") >= since // DAY)
        rows = rows.withColumn("session", _key(self.job, "lo", "batch_id"))
        gone = self._stored(spark, "gone", self.gone_rows, before).select("session")
        return lookup(rows, gone, ["session"], "lo", "left_anti", stored=True)

    def _touched(self, spark: SparkSession, spans: DataFrame, mark: int, batch_id: int) -> DataFrame:
        """Settled sessions that late spans may touch: of their meetings, and not of days before."""
        late = spans.where(F.col("lo") < mark)
        since, until = late.agg(F.min("lo") - self.gap, F.max("hi") + self.gap).first()
        near = self.settled(spark, batch_id, since).where((F.col("hi") >= since) & (F.col("lo") <= until))
        meetings = late.select(_key(self.job).alias("_job")).distinct()
        return lookup(near.withColumn("_job", _key(self.job)), meetings, ["_job"], "lo", "left_semi").drop("_job")

    def step(self, batch: DataFrame, batch_id: int, ts: str) -> None:
        spark, session = batch.sparkSession, F.lit(None).cast("string").alias("session")
        mark = self.watermark(spark, batch_id)
        spans = event_spans(batch, self.job, self.gap, ts).persist()  # read for its bounds and its runs
        try:
            first, last = spans.agg(F.min("lo"), F.max("hi")).first()
            seen = [m for m in (mark, None if last is None else last - self.delay) if m is not None]
            moved = max(seen) if seen else None
            rows = spans.select(*self.spans.names, session)
            opened = self._last(spark, "open", batch_id)
            if opened is not None:
                held = spark.read.schema(self.spans).parquet(batch_path(f"{self.path}/open", opened))
                rows = rows.unionByName(held.select("*", session))
            if mark is not None and first is not None and first < mark:
                write_batch(batch.where(epoch_micros(F.col(ts)) < mark), f"{self.path}/late", batch_id)
                rows = rows.unionByName(
                    self._touched(spark, spans, mark, batch_id).select(*self.spans.names, "session"))
            self._write(rows, moved, batch_id)
            write_batch(spark.createDataFrame([(moved,)], "mark long"), f"{self.path}/marks", batch_id)
        finally:
            spans.unpersist()
        for name in ("open", "marks"):
            keep_last_folders(spark, f"{self.path}/{name}", "batch_id", batch_id)

    def _write(self, rows: DataFrame, mark: int | None, batch_id: int) -> None:
        """Bring spans together. A run of settled sessions alone is as it was: it is left out."""
        settled = F.col("session").isNotNull()
        number = F.lit(batch_id).cast("long")
        marked = numbered_runs(rows, self.job, self.gap).persist()  # read for three tables
        try:
            made = marked.groupBy(self.job, "run").agg(
                F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"),
                F.bool_or(~settled).alias("_new")).where("_new").select(*self.spans.names)
            over = F.lit(False) if mark is None else F.col("hi") + self.gap < mark
            write_batch(made.where(~over), f"{self.path}/open", batch_id)
            (
                made.where(over).withColumns({"last_day": F.floor(F.col("hi") / DAY), "batch_id": number})
                .hint("rebalance", F.col("last_day"))
                .sortWithinPartitions("last_day", "lo")  # row groups of other hours are skipped
                .write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
                .partitionBy("last_day", "batch_id").parquet(f"{self.path}/closed")
            )
            new_runs = marked.where(~settled).select(self.job, "run").distinct()
            mine = marked.where(settled).alias("old").join(
                new_runs.alias("new"),
                F.col(f"old.{self.job}").eqNullSafe(F.col(f"new.{self.job}")) & (F.col("old.run") == F.col("new.run")),
                "left_semi")
            gone = mine.select("session", number.alias("batch_id"))
            gone.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(
                "batch_id").parquet(f"{self.path}/gone")
        finally:
            marked.unpersist()

    def current(self, spark: SparkSession) -> DataFrame:
        """Sessions as the last completed micro-batch left them, open ones too:
        ``job, segment_start, segment_end, n``."""
        newest = self._newest(spark)
        if newest is None:
            return as_segments(spark.createDataFrame([], self.spans), self.job, self.gap)
        held = spark.read.schema(self.spans).parquet(batch_path(f"{self.path}/open", newest))
        rows = self.settled(spark, newest + 1).select(*self.spans.names).unionByName(held)
        return as_segments(rows, self.job, self.gap)

    def _newest(self, spark: SparkSession) -> int | None:
        """The last micro-batch that was completed: ``marks`` are written last."""
        if not folder_exists(spark, f"{self.path}/marks"):
            return None
        return spark.read.schema("mark long, batch_id long").parquet(f"{self.path}/marks").agg(
            F.max("batch_id")).first()[0]


def keep_sessions(events: DataFrame, path: str, checkpoint: str, job: str, ts: str,
                  gap_seconds: int, delay_seconds: int) -> tuple[StreamingQuery, Sessions]:
    """Sessions of a stream kept below ``path``; read them with ``current`` or ``settled``.

    ``delay_seconds`` only decides how much is held open: whatever the order of the events,
    the sessions equal ``pause_segments`` over all of them.
    """
    kept = Sessions(path, events.schema[job], gap_seconds, delay_seconds)
    return each_batch(events, lambda rows, n: kept.step(rows, n, ts), checkpoint), kept
