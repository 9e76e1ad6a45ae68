"""Streams over several micro-batches give what the batch twins give."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rostrum.operators import lifecycle, segments, transcript
from rostrum.plans import flows, stream_queries
from rostrum.session import stage
from rostrum.sources.sinks import append_files, read_batches
from rostrum.sources.tables import read_files, stream_files
from rostrum.streaming import intake, meetings


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.fixture
def event_files(spark, tmp_path):
    """One file per hour of events, read as one micro-batch each."""
    kinds = ["start", "slice", "slice", "stop", "slice"]
    rows = [(i, f"j{i % 4}", at(i * 7), kinds[(i * i + i // 5) % 5]) for i in range(120)]
    schema = "event_id int, job_id string, ts timestamp_ntz, kind string"
    for n in range(0, 120, 30):
        spark.createDataFrame(rows[n : n + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    return whole, str(tmp_path / "in"), str(tmp_path)


def stream(spark, whole, path):
    return stream_files(spark, path, whole.schema, files_per_step=1)


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_late_slices_equal_batch(spark, event_files):
    whole, path, out = event_files
    meetings.keep_timely_slices(stream(spark, whole, path), f"{out}/late", f"{out}/ck").awaitTermination()
    slices = whole.where("kind = 'slice'").select("event_id", "job_id", "ts")
    want = lifecycle.drop_late(slices, lifecycle.stop_times(whole))
    got = read_batches(spark, f"{out}/late/slices")
    assert ids(got) == ids(want) and 0 < got.count() < slices.count()


def test_recordings_become_points(spark, event_files):
    whole, path, out = event_files
    said = lambda df: df.select(
        "*", F.when(F.col("event_id") % 9 != 4, F.concat(F.lit("word "), F.col("event_id").cast("string"), F.lit(". Speaker?")))
        .otherwise(" ").alias("text"), F.lit("f.webm").alias("file_name"),
    )
    for _ in range(2):  # the second run finds nothing new
        meetings.keep_timely_slices(
            said(stream(spark, whole, path)), f"{out}/rec", f"{out}/ck", store=meetings.store_searchable
        ).awaitTermination()
    want = flows.recordings_to_tables(said(whole))
    got = read_batches(spark, f"{out}/rec/points")
    assert sorted(map(str, got.select(want.points.columns).collect())) == sorted(map(str, want.points.collect()))
    assert got.count() == want.fragments.count() > 0
    assert read_batches(spark, f"{out}/rec/slices").count() > got.count()


def in_batches(spark, whole, cuts):
    state = spark.createDataFrame([], "job_id string, ts timestamp_ntz, kind string")
    for cut in cuts:
        state = stage(meetings.next_state(state, whole.where(cut)), "state")  # as the stream does
    return {r.job_id: r.stop_ts for r in meetings.ends(state).collect()}


def test_state_does_not_depend_on_order(spark, event_files):
    whole, _, _ = event_files
    want = {r.job_id: r.stop_ts for r in lifecycle.stop_times(whole).collect()}
    parts = [f"event_id >= {n} and event_id < {n + 30}" for n in range(0, 120, 30)]
    assert want and in_batches(spark, whole, parts) == want
    assert in_batches(spark, whole, [*parts[::-1], parts[2]]) == want  # backwards, one of them twice


def test_a_stop_may_come_before_its_meeting(spark):
    schema = "event_id int, job_id string, ts timestamp_ntz, kind string"
    rows = [(1, "a", at(5), "stop"), (2, "a", at(1), "start"), (3, "b", at(3), "start"),
            (4, "b", at(2), "stop"), (5, "b", at(9), "stop"), (6, "b", at(1), "slice"), (7, "c", at(1), "stop")]
    whole = spark.createDataFrame(rows, schema)
    assert in_batches(spark, whole, [f"event_id = {n}" for n in range(1, 8)]) == {"a": at(5), "b": at(2)}
    assert in_batches(spark, whole, ["event_id < 6"]) == {"a": at(5), "b": at(9)}


def test_late_slices_equal_batch_in_any_order(spark, event_files, tmp_path):
    whole, _, out = event_files
    whole.repartition(6, "event_id").write.parquet(f"{out}/mixed")
    for _ in range(2):  # the second run finds nothing new
        meetings.keep_timely_slices(
            stream(spark, whole, f"{out}/mixed"), f"{out}/late", f"{out}/ck"
        ).awaitTermination()
    slices = whole.where("kind = 'slice'").select("event_id", "job_id", "ts")
    want = lifecycle.drop_late(slices, lifecycle.stop_times(whole))
    stored = read_batches(spark, f"{out}/late/slices")
    assert ids(meetings.still_timely(stored, f"{out}/late")) == ids(want)
    for folder in (tmp_path / "late" / "state").glob("state_bucket=*"):
        assert len(list(folder.glob("version=*"))) <= 2


def test_progress_is_kept_across_batches(spark, event_files):
    whole, path, out = event_files
    meetings.keep_progress(
        stream(spark, whole, path), f"{out}/rows", f"{out}/ck", "job_id", "kind"
    ).awaitTermination()
    got = meetings.latest_progress(spark, f"{out}/rows", "job_id")
    want = meetings.running_progress(whole, "job_id", "kind")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_redelivered_message_is_read_once(spark, tmp_path):
    message = '{"jobId":"a","fileId":"f","metadata":null}'
    for k in range(2):
        spark.createDataFrame([(message,), (message,)], "value string").write.mode("append").text(f"{tmp_path}/in")
        intake.consume_messages(
            spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck"
        ).awaitTermination()
    stored = read_batches(spark, f"{tmp_path}/out/accepted")
    assert stored.count() == 4 and intake.accepted_once(stored).count() == 1


def test_restart_resumes_and_adds_nothing(spark, event_files):
    whole, path, out = event_files
    for _ in range(2):
        meetings.store_fragments(
            stream(spark, whole, path).select("job_id", "event_id", F.col("kind").alias("text")),
            f"{out}/rows", f"{out}/ck",
        ).awaitTermination()
    stored = read_batches(spark, f"{out}/rows")
    assert stored.count() == 120
    parts = transcript.append_fragments(stored, "job_id", ["event_id"])
    want = transcript.append_fragments(
        whole.withColumn("text", F.col("kind")), "job_id", ["event_id"]
    )
    assert sorted(map(str, parts.collect())) == sorted(map(str, want.collect()))


def test_redelivered_once_across_batches(spark, event_files):
    whole, path, out = event_files
    whole.coalesce(1).write.mode("append").parquet(path)  # everything again
    rows = stream(spark, whole, path).withColumn("ts", F.col("ts").cast("timestamp"))
    once = intake.drop_redelivered(rows, "event_id", "ts", "1 day").select("event_id")
    append_files(once, f"{out}/once", f"{out}/ck").awaitTermination()
    assert ids(spark.read.parquet(f"{out}/once")) == list(range(120))


def test_a_late_copy_does_not_hide_a_timely_one(spark, tmp_path):
    rows = [[(9, 100)], [(6, 100)], [(1, 0), (1, 101), (8, 102), (7, 1)]]
    for k, part in enumerate(rows):
        df = spark.createDataFrame(part, "key int, minute int")
        df = df.select("key", F.timestamp_seconds(F.col("minute") * 60).alias("ts"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for file in (tmp_path / "in" / str(k)).glob("*.parquet"):
            os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in this order
    read = (spark.readStream.schema("key int, ts timestamp").option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
    once = intake.drop_redelivered(read, "key", "ts", "10 minutes")
    append_files(once, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 6, 8, 9]


def test_sessions_and_windows_equal_batch_when_closed(spark, event_files):
    whole, path, out = event_files
    rows = stream(spark, whole, path).withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = meetings.activity_sessions(rows, "job_id", "ts", "5 minutes", "20 minutes")
    append_files(sessions, f"{out}/s", f"{out}/ck1").awaitTermination()
    windows = meetings.slice_windows(rows, "job_id", "ts", "5 minutes")
    append_files(windows, f"{out}/w", f"{out}/ck2").awaitTermination()
    closed = at(119 * 7 - 5)
    want = segments.pause_segments(whole, "job_id", 1200).where(F.col("segment_end") <= F.lit(closed))
    got = spark.read.parquet(f"{out}/s").select(
        "job_id", *[F.col(c).cast("timestamp_ntz") for c in ("segment_start", "segment_end")], "n"
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    want = segments.tumbling_counts(whole, "job_id").where(
        F.col("window_start") + F.expr("interval 10 minutes") <= F.lit(closed)
    )
    got = spark.read.parquet(f"{out}/w").select(F.col("window_start").cast("timestamp_ntz"), "job_id", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_messages_split_into_accepted_and_dead(spark, tmp_path):
    uploads = spark.createDataFrame(
        [(1, "a", 10, 5.0), (2, "a", 10, 0.0), (3, "", 10, 5.0), (4, "b", 26214401, 5.0)],
        "n int, job_id string, size_bytes bigint, duration_s double",
    ).select(
        "*", F.lit("f.webm").alias("file_name"), F.lit(True).alias("metadata_ok"),
        F.concat(F.lit("id"), F.col("n")).alias("file_id"), F.lit("audio/webm").alias("mimetype"),
        F.array(F.lit("webm")).alias("format_names"), F.lit(at(0)).cast("timestamp_ntz").alias("ts"),
    )
    uploads.write.parquet(str(tmp_path / "up"))
    rows = stream_files(spark, str(tmp_path / "up"), uploads.schema)
    intake.accept_uploads(rows, str(tmp_path / "messages"), str(tmp_path / "ck1")).awaitTermination()
    spark.createDataFrame([("{broken",), ('{"fileId":"x"}',)], "value string").write.text(str(tmp_path / "junk"))
    for source in ("messages", "junk"):
        messages = spark.readStream.text(str(tmp_path / source))
        intake.consume_messages(messages, str(tmp_path / f"out-{source}"), str(tmp_path / f"ck-{source}")).awaitTermination()
    good = read_batches(spark, str(tmp_path / "out-messages" / "accepted")).collect()
    assert [(r.job_id, r.file_id, r.metadata.uploadTimestamp) for r in good] == [("a", "id1", "2024-01-01T00:00:00.000Z")]
    dead = read_batches(spark, str(tmp_path / "out-junk" / "dead")).collect()
    assert sorted(r.reject_reason for r in dead) == ["no_session", "undecodable"]


def test_running_progress(spark, event_files):
    whole, path, out = event_files
    totals = meetings.running_progress(stream(spark, whole, path), "job_id", "kind")
    q = (totals.writeStream.outputMode("complete").format("memory").queryName("progress")
         .option("checkpointLocation", f"{out}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("progress").agg(F.sum("n_fragments")).first()[0] == 120


def test_declared_schema_reads(spark, tmp_path):
    spark.range(3).selectExpr("id AS event_id").write.json(str(tmp_path / "j"))
    got = read_files(spark, str(tmp_path / "j"), spark.range(1).selectExpr("id AS event_id").schema, "json")
    assert got.count() == 3


def test_message_files_of_a_step_follow_the_cores(spark):
    assert stream_queries._message_files(spark) == spark.sparkContext.defaultParallelism == 8
