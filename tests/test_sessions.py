"""Sessions that late events correct, against the batch twin."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from rostrum.operators import segments
from rostrum.sources.sinks import write_batch
from rostrum.streaming.sessions import Sessions

GAP = 600
SCHEMA = "event_id int, job_id string, ts timestamp_ntz"


@pytest.fixture(autouse=True)
def few_tasks(spark):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a step of few rows is mostly tasks to start
    yield
    spark.conf.set("spark.sql.shuffle.partitions", usual)


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def events(spark, rows):
    return spark.createDataFrame([(i, j, None if m is None else at(m)) for i, (j, m) in enumerate(rows)], SCHEMA)


def keep(spark, path, parts, delay=60):
    kept = Sessions(str(path), events(spark, []).schema["job_id"], GAP, delay)
    for number, part in enumerate(parts):
        kept.step(events(spark, part), number, "ts")
    return kept


def table(df):
    return sorted(map(str, df.select("job_id", "segment_start", "segment_end", "n").collect()))


def want(spark, parts):
    return table(segments.pause_segments(events(spark, sum(parts, [])), "job_id", GAP))


def test_any_order_equals_batch(spark, tmp_path):
    pick = random.Random(7)
    rows = [(f"j{pick.randrange(3)}", pick.randrange(4000)) for _ in range(150)]
    rows += [(None, 5), (None, 8), (None, 900), ("j0", None)] + rows[:5]  # no meeting, no time, copies
    pick.shuffle(rows)
    parts = [rows[n::4] for n in range(4)] + [[]]
    kept = keep(spark, tmp_path, parts)
    assert table(kept.current(spark)) == want(spark, parts)


@pytest.mark.parametrize("late, sessions", [
    ([("a", 8)], 3), ([("a", 12), ("a", 20)], 2), ([("a", 60)], 4), ([("b", 8)], 4), ([("a", 10)], 3)])
def test_lengthen_bridge_and_new(spark, tmp_path, late, sessions):
    parts = [[("a", 0), ("a", 5)], [("a", 30)], [("a", 500)], late]
    kept = keep(spark, tmp_path, parts)
    assert table(kept.current(spark)) == want(spark, parts)
    assert kept.current(spark).count() == sessions
    assert spark.read.parquet(f"{tmp_path}/late").count() == len(late)


def test_only_touched_sessions_are_made_anew(spark, tmp_path):
    parts = [[(f"j{n % 5}", 60 * n) for n in range(100)], [("j0", 10_000)], [("j1", 63), ("j2", 9_000)]]
    kept = keep(spark, tmp_path, parts[:2])
    files = {f: os.stat(f).st_mtime_ns for f in map(str, tmp_path.glob("closed/*/*/*.parquet"))}
    before = {r.session for r in kept.settled(spark).collect()}
    kept.step(events(spark, parts[2]), 2, "ts")
    assert table(kept.current(spark)) == want(spark, parts)
    assert len(before - {r.session for r in kept.settled(spark).collect()}) == 1  # j1 at 60
    now = {f: os.stat(f).st_mtime_ns for f in map(str, tmp_path.glob("closed/*/*/*.parquet"))}
    assert files.items() <= now.items()


def test_a_batch_may_run_again(spark, tmp_path):
    parts = [[("a", 0), ("a", 5)], [("a", 30), ("b", 400)], [("a", 18), ("b", 3)]]
    kept = keep(spark, tmp_path, parts)
    for _ in range(2):
        kept.step(events(spark, parts[2]), 2, "ts")
        assert table(kept.current(spark)) == want(spark, parts)


def test_a_half_written_batch_is_not_seen(spark, tmp_path, monkeypatch):
    parts = [[("a", 0), ("a", 5)], [("a", 30), ("b", 400)]]
    kept = keep(spark, tmp_path, parts)
    late = [("a", 18), ("b", 900)]
    with monkeypatch.context() as broken:
        broken.setattr(kept, "watermark", lambda *_: 1 << 62)  # everything settles, then the step fails
        broken.setattr("rostrum.streaming.sessions.keep_last_folders", None)
        broken.setattr("rostrum.streaming.sessions.write_batch", failing_marks)
        with pytest.raises(RuntimeError):
            kept.step(events(spark, late), 2, "ts")
    assert table(kept.current(spark)) == want(spark, parts)


def failing_marks(rows, path, batch_id):
    if path.endswith("/marks"):
        raise RuntimeError("lost before its end")
    write_batch(rows, path, batch_id)


def test_no_events_at_all(spark, tmp_path):
    assert keep(spark, tmp_path / "none", []).current(spark).count() == 0
    kept = keep(spark, tmp_path, [[], [("a", None)]])
    assert kept.current(spark).count() == 0
    kept.step(events(spark, [("a", 3)]), 2, "ts")
    assert kept.current(spark).agg(F.sum("n")).first()[0] == 1


def test_old_days_are_not_read(spark, tmp_path):
    day = 24 * 60
    kept = keep(spark, tmp_path, [[("a", n * day) for n in range(6)], [("a", 20 * day)]])
    since = int((at(4 * day) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    recent = kept.settled(spark, since=since)
    assert recent.count() == 2 and kept.settled(spark).count() == 6
    assert "PartitionFilters: [isnotnull(last_day" in recent._jdf.queryExecution().executedPlan().toString()
