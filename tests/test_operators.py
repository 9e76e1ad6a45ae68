"""Operators on small tables, hot-key paths included."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.limits import ANSWER_ERROR, NO_ANSWER, NO_CHATS, NO_SNIPPETS, NO_TRANSCRIPT
from rostrum.operators import (
    attempts, chats, context, frames, intake, lifecycle, ordering, quality, retrieval,
    segments, transcript, vector_table,
)
from rostrum.operators import lookup as lookup_module
from rostrum.operators.lookup import lookup
from rostrum.plans import flows
from rostrum.sources.by_job import read_by_job, write_by_job


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_reject_reasons_in_order(spark):
    nan = float("nan")
    rows = [
        (26214400, "f", "j", True, 900.0, None), (26214401, "f", "j", True, 900.0, "file_too_large"),
        (26214401, "f", None, False, 0.0, "file_too_large"), (None, None, None, False, None, "no_audio_file"),
        (1, "f", None, False, 0.0, "no_session"), (1, "f", "", True, 1.0, "no_session"),
        (1, "f", " ", True, 1.0, None), (1, "f", "j", False, 0.0, "unreadable_metadata"),
        (1, "f", "j", True, 0.0, "no_duration"), (1, "f", "j", True, None, "no_duration"),
        (1, "f", "j", True, nan, "no_duration"), (1, "f", "j", True, 900.001, "too_long"),
        (1, "f", "j", True, -1.0, None),
    ]
    schema = "i int, size_bytes bigint, file_name string, job_id string, metadata_ok boolean, duration_s double, want string"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    got = intake.validate_uploads(df).orderBy("i").collect()
    assert [r.reject_reason for r in got] == [r.want for r in got]


def test_decode_messages(spark):
    rows = ['{"jobId":"a","fileId":"f"}', '{"jobId":"a","fileId":"f","metadata":{"size":3}}',
            "not json", None, '{"jobId":"a"', '{"jobId":"a"} tail']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, value string")
    got = intake.decode_messages(df).orderBy("i").collect()
    assert [r.decoded for r in got] == [True, True, False, False, False, False]
    assert got[0].metadata is not None and got[0].metadata.size is None
    assert got[1].metadata.size == 3 and got[2].job_id is None


def test_retry_skips_done(spark):
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "event_id int")
    got = intake.retry(frame([1, 2]), frame([2, 3, 4]), frame([4]), "event_id").collect()
    assert sorted(r.event_id for r in got) == [1, 2, 3]


EVENTS = [
    # stop before the meeting exists, then a slice creates it, a real stop, a second start
    ("a", 0, "stop"), ("a", 5, "slice"), ("a", 10, "stop"), ("a", 10, "slice"), ("a", 11, "slice"),
    ("a", 12, "start"), ("a", 20, "stop"),
    ("b", 1, "start"), ("b", 9, "slice"),
    ("c", 3, "stop"),
    # a stop at the very moment of creation does not count
    ("d", 4, "start"), ("d", 4, "stop"), ("d", 6, "slice"),
]


@pytest.fixture
def meeting_events(spark):
    rows = [(i, j, at(m), k) for i, (j, m, k) in enumerate(EVENTS)]
    return spark.createDataFrame(rows, "event_id int, job_id string, ts timestamp_ntz, kind string")


def test_meetings(meeting_events):
    got = {r.job_id: (r.created_at, r.status) for r in lifecycle.meetings(meeting_events).collect()}
    assert got == {
        "a": (at(5), "completed"), "b": (at(1), "in-progress"), "d": (at(4), "in-progress"),
    }
    stops = {r.job_id: r.stop_ts for r in lifecycle.stop_times(meeting_events).collect()}
    assert stops == {"a": at(10)}


def test_late_slices(meeting_events):
    slices = meeting_events.where("kind = 'slice'").select("event_id", "job_id", "ts")
    stops = lifecycle.stop_times(meeting_events)
    kept = lambda grace: sorted(r.event_id for r in lifecycle.drop_late(slices, stops, grace).collect())
    assert kept("0 seconds") == [1, 3, 8, 12]
    assert kept("1 minute") == [1, 3, 4, 8, 12]
    alive = lifecycle.drop_completed(slices, lifecycle.meetings(meeting_events)).collect()
    assert sorted(r.event_id for r in alive) == [8, 12]


def test_status_of_unknown_meeting(spark, meeting_events):
    jobs = spark.createDataFrame([(1, "a"), (2, "nowhere"), (3, None)], "event_id int, job_id string")
    got = {r.job_id: r.status for r in lifecycle.with_status(jobs, lifecycle.meetings(meeting_events)).collect()}
    assert got == {"a": "completed", "nowhere": None, None: None}


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows and more belong to one key; some have no key."""
    rnd = random.Random(7)
    rows = [(rnd.choice(["hot", "hot", "k1", "k2", "k3", None]), rnd.randrange(40), i) for i in range(600)]
    rows = [(k, t, i, f"t{i}" if i % 13 else "  ") for k, t, i in rows]
    return spark.createDataFrame(rows, "k string, t int, i int, text string").repartition(5).cache()


def test_numbers_do_not_depend_on_the_path(skewed):
    plain = ordering.number_rows(skewed, "k", ["t", "i"])
    for limit in (150, 20, 0):
        cut = ordering.number_rows(skewed, "k", ["t", "i"], rows_per_task=limit)
        assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_next_row_does_not_depend_on_the_path(skewed):
    plain = ordering.with_next(skewed, "k", ["t", "i"], ["i", "text"])
    for limit in (150, 0):
        cut = ordering.with_next(skewed, "k", ["t", "i"], ["i", "text"], rows_per_task=limit)
        assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_scratch_is_shared_and_cleared(spark, skewed):
    from pathlib import Path

    from rostrum.session import clear_scratch, scratch_path, shared_folder, stage

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert stage(skewed, "x").count() == skewed.count()
    assert list(Path(scratch_path(spark, "y")).parent.glob("x-*"))
    clear_scratch(spark)
    assert not Path(scratch_path(spark, "y")).parent.exists()


@pytest.mark.parametrize("limit", [1000, 0])
def test_lookup_equals_join(spark, skewed, limit):
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k9", 3)], "k string, v int")
    for how in ("left", "inner", "left_anti", "left_semi"):
        want = skewed.join(dim, "k", how)
        got = lookup(skewed, dim, ["k"], "i", how, broadcast_bytes=limit)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (limit > 0)


def test_broadcast_goes_by_bytes(spark):
    dim = spark.createDataFrame([("a" * 5000, 1, ["x"]), (None, 2, None)], "k string, v int, l array<string>")
    assert 5000 < lookup_module.payload_bytes(dim) < 5200
    assert lookup_module.payload_bytes(dim.limit(0)) == 0


def test_hot_keys_are_found(skewed):
    found = lambda n: {r._hot for r in ordering.hot_keys(skewed, "k", n).collect()}
    assert found(150) == {"hot"}
    assert found(0) == {"hot", "k1", "k2", "k3", None}


def test_any_number_of_hot_keys(spark):
    rows = spark.range(36_000).selectExpr("id % 12000 AS k", "id AS i")
    got = ordering.number_rows(rows, "k", ["i"], rows_per_task=2)
    assert got.where("n != i div 12000 + 1").count() == 0 and got.count() == 36_000


def test_fragments_keep_one_shape(spark, skewed):
    want = transcript.append_fragments(skewed, "k", ["t", "i"]).collect()
    assert not any(r.text.strip() == "" for r in want)
    got = transcript.append_fragments(skewed, "k", ["t", "i"], rows_per_task=0).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    long = spark.range(600).selectExpr("'m' AS k", "id AS t", "concat('w', id) AS text")
    for limit in (10**6, 100):
        said = transcript.append_fragments(long, "k", ["t"], rows_per_task=limit)
        assert said.count() == 600
        only = transcript.transcript_of(said, "k", "m").collect()
        assert [tuple(r) for r in only] == [("m", 600, " ".join(f"w{n}" for n in range(600)))]


def test_full_transcript_default(spark, tmp_path):
    jobs = spark.createDataFrame([("a",), ("b",)], "job string")
    said = spark.createDataFrame(
        [("a", 2, "world"), ("a", 1, "hello"), ("b", 1, " \n")], "job string, n int, text string"
    )
    rows = transcript.full_transcripts(jobs, said, "job", ["n"]).collect()
    assert sorted(map(tuple, rows)) == [("a", 1, "hello"), ("a", 2, "world"), ("b", 0, NO_TRANSCRIPT)]
    appended = transcript.append_fragments(said, "job", ["n"])
    write_by_job(appended, str(tmp_path / "t"), "job")
    appended = read_by_job(spark, str(tmp_path / "t"), "job")
    assert [tuple(r) for r in transcript.transcript_of(appended, "job", "a").collect()] == [("a", 2, "hello world")]
    assert transcript.transcript_of(appended, "job", "b").count() == 0


def test_pause_segments_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [("a", at(m)) for m in (0, 30, 60, 91, 200, 200)]
    rows += [("b", at(rnd.randrange(0, 3000) / 2)) for _ in range(60)]
    df = spark.createDataFrame(rows, "job string, ts timestamp_ntz")
    want = []
    for job in ("a", "b"):
        times = sorted(t for j, t in rows if j == job)
        start = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] > dt.timedelta(minutes=30):
                want.append((job, times[start], times[i - 1] + dt.timedelta(minutes=30), i - start))
                start = i
    got = segments.pause_segments(df, "job", 1800).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    sessions = df.groupBy("job", F.session_window("ts", "30 minutes").alias("w")).count()
    assert sorted((r.job, r.w.start, r.w.end, r[2]) for r in sessions.collect()) == sorted(want)


def brute(prompts, candidates, k, before=False, other=False):
    out = []
    for job, pid, p_ord, pv in prompts:
        scored = []
        for c_job, cid, c_ord, cv in candidates:
            if job != c_job or (before and c_ord >= p_ord) or (other and pid == cid):
                continue
            length = np.linalg.norm(pv) * np.linalg.norm(cv)
            if length > 0:
                scored.append((-round(float(np.dot(pv, cv) / length), 6), cid))
        out += [(job, pid, cid, rank + 1, -s) for rank, (s, cid) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        job = "hot" if i % 3 else f"j{i % 5}"
        vec = rng.integers(-2, 3, 6).astype(float)
        if i % 19 == 0:
            vec[:] = 0
        rows.append((job, f"v{i:03d}", i, vec.tolist()))
    rows += [("hot", f"copy{i}", i, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]) for i in range(40)]
    return rows


@pytest.mark.parametrize("block", [4096, 25, 7])
@pytest.mark.parametrize("before,other", [(False, False), (True, False), (False, True)])
def test_top_similar_is_exact(spark, vectors, block, before, other):
    df = spark.createDataFrame(vectors, "job string, id string, n int, v array<double>")
    got = retrieval.top_similar(
        df, df, 4, job="job", prompt_id="id", candidate_id="id", vector="v", size=6,
        prompt_order="n" if before else None, candidate_order="n" if before else None,
        exclude_self=other, block_rows=block,
    ).collect()
    want = brute(vectors, vectors, 4, before, other)
    assert [(*r[:4], round(r[4], 6) + 0.0) for r in sorted(map(tuple, got))] == [
        (*r[:4], round(r[4], 6) + 0.0) for r in want
    ]


def test_top_similar_sparse_and_numeric_ids(spark):
    rows = [(1, 10, [(0, 1)]), (1, 11, [(0, 1), (5, 2)]), (1, 12, []), (2, 13, [(0, 9)]), (1, 14, None)]
    df = spark.createDataFrame(rows, "job bigint, id bigint, v array<struct<bucket:int,tf:int>>")
    got = retrieval.top_similar(df, df, 5, job="job", prompt_id="id", candidate_id="id",
                                vector="v", exclude_self=True).collect()
    assert sorted((r.prompt_id, r.candidate_id, r.score) for r in got) == [
        (10, 11, round(1 / 5 ** 0.5, 6)), (11, 10, round(1 / 5 ** 0.5, 6)),
    ]


def test_top_similar_for_few_meetings(spark, vectors):
    """Only some meetings are asked about; prompts may lack a meeting or have none of their own."""
    df = spark.createDataFrame(vectors, "job string, id string, n int, v array<double>")
    asked = [r for r in vectors if r[0] in ("j1", "j3")]
    lone = [(None, "p0", 1, [1.0] * 6), ("elsewhere", "p1", 1, [1.0] * 6)]
    prompts = spark.createDataFrame(asked + lone, df.schema)
    got = retrieval.top_similar(prompts, df.unionByName(prompts.where("job is null")), 3, job="job",
                                prompt_id="id", candidate_id="id", vector="v", size=6)
    assert [(*r[:4], r[4] + 0.0) for r in sorted(map(tuple, got.collect()))] == [
        (*r[:4], r[4] + 0.0) for r in brute(asked, vectors, 3)
    ]
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()


def test_top_similar_without_rows(spark, vectors):
    df = spark.createDataFrame(vectors, "job string, id string, n int, v array<double>")
    none = df.where("id = 'absent'")
    for left, right in ((none, df), (df, none)):
        assert retrieval.top_similar(left, right, 3, job="job", prompt_id="id",
                                     candidate_id="id", vector="v", size=6).count() == 0


def test_search_one_meeting(spark, vectors):
    df = spark.createDataFrame(vectors, "job string, id string, n int, v array<double>")
    prompt = [1.0, 0.0, 2.0, 0.0, 0.0, -1.0]
    got = retrieval.search(df, 4, job="job", job_value="hot", prompt=F.array(*map(F.lit, prompt)),
                           candidate_id="id", vector="v").collect()
    want = brute([("hot", "p", 0, prompt)], vectors, 4)
    want = sorted(want, key=lambda w: w[3])  # by rank
    assert [(r.id, r.score) for r in got] == [(w[2], w[4]) for w in want]
    assert "v" not in got[0].asDict()


TURNS = [("a", 0, "system", "s"), ("a", 1, "user", "q1"), ("a", 2, "assistant", "r1"), ("a", 3, "user", "q2"),
         ("a", 5, "user", "q3"), ("a", 9, "assistant", "r3"), ("b", 0, "assistant", "r"), ("b", 1, "user", "q")]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_chat_pairs(spark, limit):
    df = spark.createDataFrame(TURNS, "c string, turn int, role string, text string")
    got = sorted(map(tuple, chats.chat_pairs(df, "c", "turn", rows_per_task=limit).collect()))
    assert got == [("a", 1, "q1", "r1"), ("a", 3, "q2", None), ("a", 5, "q3", "r3"), ("b", 1, "q", None)]


def test_history_pages(spark):
    rows = [("a", n, f"u{n}", None) for n in range(8)] + [("b", 1, "x", "y")]
    df = spark.createDataFrame(rows, "job string, n int, user_chat string, ai_chat string")
    page = chats.history_page(df, "job", "a", "n", "n", before=6).collect()
    assert [r.n for r in page] == [1, 2, 3, 4, 5]
    assert [r.n for r in chats.history_page(df, "job", "a", "n", "n", limit=2).collect()] == [6, 7]
    cursors = spark.createDataFrame([("a", 2)], "job string, before_id int")
    pages = chats.history_pages(df, "job", "n", "n", before=cursors).collect()
    assert sorted((r.job, r.n, r.pos) for r in pages) == [("a", 0, 1), ("a", 1, 2), ("b", 1, 1)]


def test_answers_update_chats(spark):
    made = chats.create_chats(spark.createDataFrame([(1, "q"), (2, "r")], "id int, t string"), ["id"], "t")
    answers = spark.createDataFrame([(1, "yes"), (9, "lost")], "id int, answer string")
    got = sorted(map(tuple, chats.answer_chats(made, answers, ["id"]).collect()))
    assert got == [(1, "q", "yes"), (2, "r", None)]
    assert [r.id for r in chats.answers_without_chat(made, answers, ["id"]).collect()] == [9]


def test_context_defaults_and_quoting(spark):
    prompts = spark.createDataFrame([(1, "why?"), (2, "who?")], "id int, question string")
    hits = spark.createDataFrame(
        [(1, 2, 'say "x"\n', "b"), (1, 1, "é\\", "a")], "id int, rank int, user string, ai string"
    )
    snippets = context.joined_hits(hits, ["id"], context.snippet_line(F.col("ai")), "snippets")
    pairs = context.joined_hits(hits, ["id"], context.chat_lines(F.col("user"), F.col("ai")), "chats")
    got = {r.id: r.context for r in context.prompt_context(prompts, snippets, pairs, ["id"], "question").collect()}
    assert got[1] == (
        "# Meeting Transcription Context:\nTranscription Snippet: a\nTranscription Snippet: b\n\n"
        '# Relevant Chat History:\nUser: "é\\\\"\nAI: a\nUser: "say \\"x\\"\\n"\nAI: b\n\n'
        "# User's Question:\nwhy?"
    )
    assert NO_SNIPPETS in got[2] and NO_CHATS in got[2] and got[2].endswith("\nwho?")


def test_cleaning_takes_the_first_valid_attempt(spark):
    good = '[{"summary":"s","refined_text":"- t"}]'
    rows = [(1, 1, "x"), (1, 2, good), (1, 3, "[]"), (2, 1, "x"), (2, 2, None), (2, 3, "Sure: []"),
            (3, 1, "x"), (3, 2, "x"), (3, 3, good + " ]"), (3, 4, good)]
    df = spark.createDataFrame(rows, "id int, attempt int, response string")
    resolved = attempts.resolve_cleaning(df, ["id"])
    got = {r.id: (r.attempt, r.outcome) for r in resolved.collect()}
    assert got == {1: (2, "ok"), 2: (3, "ok"), 3: (None, "dead")}
    flat = attempts.cleaned_chunks(resolved, ["id"]).collect()
    assert [tuple(r) for r in flat] == [(1, 0, "s", "- t")]


def test_cleaner_responses_become_points(spark):
    recordings = spark.createDataFrame(
        [(i, "a", at(i), "text", f"f{i}") for i in (1, 2, 3)],
        "event_id int, job_id string, ts timestamp_ntz, text string, file_name string",
    )
    responses = spark.createDataFrame([
        ("a", 1, 1, '[{"summary":"s","refined_text":"- fine words\\n"},{"summary":"s","refined_text":"- Speaker A: hi"}]'),
        ("a", 2, 1, '[{"refined_text":"- no summary"}]'), ("a", 3, 1, "none"), ("a", 3, 2, None),
    ], "job_id string, event_id int, attempt int, response string")
    tables = flows.store_cleaned(responses, recordings)
    assert [(r.text, r.filename, r.summary) for r in tables.points.collect()] == [("- fine words\n", "f1", "s")]
    assert sorted((r.event_id, r.chunk_idx, r.reject_reason) for r in tables.rejected.collect()) == [
        (1, 1, "speaker_label"), (2, 0, "missing_summary")]
    assert [r.event_id for r in tables.dead.collect()] == [3]


def test_labels_said_in_a_meeting_stay_searchable(spark):
    rows = [(1, "a", at(1), "slice", "Note: buy milk", "f")]
    df = spark.createDataFrame(rows, "event_id int, job_id string, ts timestamp_ntz, kind string, text string, file_name string")
    assert [r.text for r in flows.recordings_to_tables(df).points.collect()] == ["- Note: buy milk\n"]


def test_answers_and_apologies(spark):
    rows = [(1, 1, " \n", False), (1, 2, "yes", False), (2, 1, None, True), (2, 2, "", False),
            (3, 1, "", False), (3, 2, None, True), (4, 1, "first", False), (4, 2, "second", False),
            (5, 1, "", False), (5, 2, "\t", False), (5, 3, "too late", False)]
    df = spark.createDataFrame(rows, "id int, attempt int, response string, failed boolean")
    got = {r.id: (r.attempt, r.answer) for r in attempts.resolve_answers(df, ["id"]).collect()}
    assert got == {1: (2, "yes"), 2: (None, NO_ANSWER), 3: (None, ANSWER_ERROR),
                   4: (1, "first"), 5: (None, NO_ANSWER)}


LINES = ['data: {"text": "a "}', ":heartbeat", ' {"text":"b"} ', 'data: {"text": ""}', 'data: {"text": "cu',
         "", "data:", 'data: {"text": "\\n\\u00e9"}', "event: x", 'data: {"event": "stream_end"}',
         'data: {"text": "late"}', 'data: {"event": "stream_end"}']


def test_frames(spark):
    rows = [("x", i, line) for i, line in enumerate(LINES)]
    rows += [("y", 0, 'data: {"text":"1"}'), ("y", 1, "data: [DONE]"), ("y", 2, 'data: {"text":"2"}'),
             ("z", 0, 'data: {"text":"open"}')]
    df = spark.createDataFrame(rows, "id string, seq int, line string")
    got = {r.id: r.text for r in frames.rebuild_answers(df, ["id"]).collect()}
    assert got == {"x": "a b\né", "y": "1", "z": "open"}


def test_a_long_answer_is_one_row(spark):
    log = spark.range(10_000).select(
        F.lit("x").alias("id"), F.col("id").alias("seq"),
        F.concat(F.lit('data: {"text":"'), F.col("id").cast("string"), F.lit('."}')).alias("line"))
    (row,) = frames.rebuild_answers(log.repartition(7), ["id"]).collect()
    assert row.text == "".join(f"{i}." for i in range(10_000))


def test_last_answer_counts(spark):
    made = spark.createDataFrame([(1, "q", None), (2, "p", "kept")], "id int, user_chat string, ai_chat string")
    answers = spark.createDataFrame([(1, 1, "first"), (1, 3, "last"), (1, 2, "second")],
                                    "id int, at int, answer string")
    got = chats.answer_chats(made, answers, ["id"], "at").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "q", "last"), (2, "p", "kept")]


def test_vector_contract_and_usable(spark):
    rows = [(1, [1.0, 0.0]), (1, []), (1, None), (1, [0.0, 0.0]), (1, [1.0]), (2, [])]
    df = spark.createDataFrame(rows, "job int, vector array<float>")
    got = {r.job: tuple(r)[1:] for r in vector_table.contract_report(df, "job", "vector", 2).collect()}
    assert got == {1: (5, 2, 1, 1, 1, False), 2: (1, 1, 0, 0, 0, True)}
    fits = df.where("vector is null or size(vector) != 1")
    assert vector_table.usable(fits, size=2).count() == 2
    with pytest.raises(Exception, match="vector width"):
        vector_table.usable(df, size=2).collect()


def test_points_are_idempotent_and_prunable(spark, tmp_path):
    chunk = spark.sql(
        """SELECT 'j' || (id % 3) AS job_id, id AS source_id, 0L AS chunk_idx, 'text ' || id AS text,
           'sum' AS summary, 'f.webm' AS original_file_name,
           timestamp_ntz'2024-01-01 00:00:00' AS ts, 0 AS seq FROM range(12)"""
    )
    points = vector_table.embed(vector_table.transcript_points(chunk), "text")
    later = points.withColumn("seq", F.lit(1)).withColumn("summary", F.lit("new"))
    path = str(tmp_path / "points")
    for batch in (points, later, later):
        vector_table.write_points(vector_table.usable(batch), path, buckets=4)
    stored = vector_table.latest_points(read_by_job(spark, path, "job_id", buckets=4))
    assert stored.count() == 12 and {r.summary for r in stored.collect()} == {"new"}
    one = read_by_job(spark, path, "job_id", "j1", buckets=4)
    assert {r.job_id for r in one.collect()} == {"j1"} and one.count() == 12
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(job_bucket" in plan


def test_user_supplied_embedding(spark):
    rows = spark.createDataFrame([("ab",), ("c",)], "t string")
    got = vector_table.embed(rows, "t", fn=lambda c: F.array(F.length(c).cast("float"))).collect()
    assert [r.vector for r in got] == [[2.0], [1.0]]


def test_constraints(spark):
    meetings = spark.createDataFrame(
        [("a", "in-progress"), ("a", "completed"), ("b", "pending"), (None, None), (None, "completed")],
        "job_id string, status string",
    )
    said = spark.createDataFrame([("a", "x"), (None, ""), ("b", None)], "job_id string, user_chat string")
    got = dict(map(tuple, quality.constraint_report(meetings, said).collect()))
    assert got == {"meeting_job_missing": 2, "meeting_status_invalid": 2, "meeting_job_repeated": 1,
                   "chat_job_missing": 1, "chat_text_missing": 2}


def test_orphans(spark):
    said = spark.createDataFrame([(1,), (2,)], "id int")
    stored = spark.createDataFrame([(2,), (3,)], "id int")
    got = sorted(map(tuple, chats.vector_orphans(said, stored, ["id"]).collect()))
    assert got == [(1, "unembedded"), (3, "orphan")]
