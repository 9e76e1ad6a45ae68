"""State by key: equal to batch, gone when settled, bound to the keys of a step."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rostrum.operators import lifecycle, transcript
from rostrum.sources.sinks import append_files
from rostrum.sources.tables import stream_files
from rostrum.streaming import keyed

EVENTS = "event_id long, job_id string, ts timestamp, kind string"
FAR = dt.datetime(2100, 1, 1)


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def put(spark, path, rows, schema):
    """One more file, read after those before it."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def step(spark, tmp_path, rows, **settings):
    """Give a stream of meetings one more file; what it has emitted so far, and its state."""
    put(spark, f"{tmp_path}/in", rows, EVENTS)
    schema = spark.createDataFrame([], EVENTS).schema
    events = stream_files(keyed.keyed_state(spark), f"{tmp_path}/in", schema, files_per_step=1)
    append_files(keyed.meeting_states(events, **settings), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    out = spark.read.schema(keyed.MEETING_ROWS).parquet(f"{tmp_path}/out").collect()
    kept = spark.read.format("statestore").option("stateVarName", "about").load(f"{tmp_path}/ck")
    return out, sorted(r.key.job_id for r in kept.collect())


def slices(out):
    return sorted(r.event_id for r in out if r.what == "slice")


def test_slices_wait_until_they_are_decided(spark, tmp_path):
    go = lambda rows: step(spark, tmp_path, rows, delay="10 minutes", keep=600.0, idle=7200.0)
    out, kept = go([(1, "a", at(0), "start"), (2, "a", at(5), "slice"), (3, "b", at(20), "stop")])
    assert slices(out) == [2] and kept == ["a", "b"]  # the watermark is at minute 10
    # A stop that comes after later events, and slices before and behind it.
    out, kept = go([(4, "a", at(12), "stop"), (5, "a", at(11), "slice"), (6, "a", at(13), "slice"),
                    (7, "a", at(12), "slice"), (8, "c", at(30), "slice")])
    assert slices(out) == [2, 5, 7] and kept == ["a", "b", "c"]
    out, kept = go([(9, "c", at(60), "slice")])
    assert [(r.created_at, r.stop_ts) for r in out if r.what == "meeting"] == [(at(0), at(12))]
    assert slices(out) == [2, 5, 7, 8] and kept == ["b", "c"]
    out, kept = go([(10, "d", at(400), "start"), (11, "a", at(2), "slice")])  # 11 is too late
    assert slices(out) == [2, 5, 7, 8, 9] and kept == ["d"]  # b never started: gone without a row
    assert {r.job_id: r.stop_ts for r in out if r.what == "meeting"} == {"a": at(12), "c": None}


@pytest.mark.parametrize("grace", [0.0, 300.0])
def test_any_order_equals_batch(spark, tmp_path, grace):
    kinds = ["start", "slice", "slice", "stop", "slice"]
    rows = [(i, f"j{i % 7}", at(i * 7), kinds[(i * i + i // 5) % 5]) for i in range(150)]
    rows += [(900, "late", at(3), "stop"), (901, None, at(3), "slice"), (902, "x", None, "slice")]
    mixed = sorted(rows, key=lambda r: (r[0] * 37) % 101)
    for n in range(5):
        out, kept = step(spark, tmp_path, mixed[n::5], delay="2 days", grace=grace)
    assert len(kept) == 8  # seven meetings and a stop without one
    out, kept = step(spark, tmp_path, [(999, "end", FAR, "none")], delay="2 days", grace=grace)
    assert kept == ["end"]
    whole = spark.createDataFrame(rows, EVENTS).where("job_id is not null and ts is not null")
    stops = lifecycle.stop_times(whole)
    want = lifecycle.drop_late(whole.where("kind = 'slice'").drop("kind"), stops, f"{int(grace)} seconds")
    assert slices(out) == sorted(r.event_id for r in want.collect())
    ends = {r.job_id: r.stop_ts for r in stops.collect()}
    assert {r.job_id: (r.created_at, r.stop_ts) for r in out if r.what == "meeting"} == {
        r.job_id: (r.created_at, ends.get(r.job_id)) for r in lifecycle.meetings(whole).collect()}


def test_a_step_touches_its_own_meetings(spark, tmp_path):
    """Rows of state written by a step follow its meetings, not those ever seen."""
    many = [(i, f"j{i}", at(0), "start") for i in range(500)]
    put(spark, f"{tmp_path}/in", many, EVENTS)
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        events = stream_files(keyed.keyed_state(spark), f"{tmp_path}/in", schema, files_per_step=1)
        q = append_files(keyed.meeting_states(events, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination()
        return [p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.numInputRows]

    first = run()
    put(spark, f"{tmp_path}/in", [(1000 + i, f"j{i}", at(5), "slice") for i in range(3)], EVENTS)
    assert run()[0] < 40 < first[0]


def test_transcript_after_every_step(spark, tmp_path):
    said = [(f"c{i % 3}", i * 17 % 64, None if i % 11 == 5 else " " if i % 13 == 4 else f"text {i}") for i in range(64)]
    schema = "conv string, turn long, text string"
    for n in range(4):
        part = said[n * 16:n * 16 + 16] + said[:3] + [(None, 1, "x"), ("c0", None, "x")]  # some again
        put(spark, f"{tmp_path}/in", part, schema)
        rows = stream_files(keyed.keyed_state(spark), f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        append_files(keyed.running_transcript(rows, "conv", "turn"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        changes = spark.read.schema(keyed.FRAGMENT_ROWS).parquet(f"{tmp_path}/out")
        so_far = spark.createDataFrame(said[:n * 16 + 16], schema)
        want = transcript.append_fragments(so_far, "conv", ["turn"])
        got = keyed.current_transcript(changes)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert changes.where("text is null").count() > 0  # late ones were corrected
    numbered = changes.where("version = 1")
    assert numbered.where("text is null").count() == 0
    again = changes.groupBy("job_id", "place").agg(F.count("text").alias("n")).where("n <> 1")
    assert again.count() == 0
