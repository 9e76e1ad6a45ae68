"""Queries with every limit set so low that all rows take the path of hot keys."""

import pytest
from check_oracles import compare, open_oracle

from rostrum.operators import chats, lookup, ordering, retrieval, transcript

FOLDER = "/root/testdata/sf0.001"
LOW = [
    (ordering.ROWS_PER_TASK, 2, (ordering, transcript, chats)),
    (lookup.BROADCAST_BYTES, 0, (lookup,)),
    (retrieval.BLOCK_ROWS, 3, (retrieval,)),
]
QUERIES = [
    "chunk_number", "transcript_append", "full_transcript", "chat_pairs", "chat_history_page",
    "topk_chunks", "text_topk", "topk_chats", "rag_context", "late_drop", "meeting_status",
    "drop_completed", "stream_reassembly", "recording_points", "stream_late_drop", "text_topk_all",
    "stream_transcript", "one_transcript",
]


@pytest.fixture
def low_limits(monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_JOBS", 0)
    for usual, low, modules in LOW:
        swap = lambda v: low if type(v) is int and v == usual else v
        for fn in {f for m in modules for f in vars(m).values() if hasattr(f, "__kwdefaults__")}:
            if fn.__defaults__:
                monkeypatch.setattr(fn, "__defaults__", tuple(map(swap, fn.__defaults__)))
            if fn.__kwdefaults__:
                monkeypatch.setattr(fn, "__kwdefaults__", {k: swap(v) for k, v in fn.__kwdefaults__.items()})


@pytest.mark.parametrize("name", QUERIES)
def test_hot_path_matches_sql(spark, low_limits, name):
    ok, rows, _, diff = compare(spark, open_oracle(FOLDER), name, FOLDER)
    assert ok and rows > 0, diff
