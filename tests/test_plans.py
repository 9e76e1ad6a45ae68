"""Plans the queries must keep: no pair products, no row-wise Python, pruned scans."""

import pytest

import __spark_entry__ as entry
from rostrum.operators import chats
from rostrum.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_") or n == "stream_reassembly")


def plan_of(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pair_products_and_no_row_python(spark, name):
    plan = plan_of(spark, name)
    banned = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"]
    if name != "constraint_report":  # totals: one row per task meets in one
        banned.append("SinglePartition")
    assert not [b for b in banned if b in plan]


@pytest.mark.parametrize("name", ["topk_chunks", "text_topk", "vector_upsert"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_pages_of_a_table_are_limited_before_the_shuffle(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 10 AS job", "id AS n", "'q' AS user_chat")
    rows.write.parquet(str(tmp_path / "chats"))
    pages = chats.history_pages(spark.read.parquet(str(tmp_path / "chats")), "job", "n", "n")
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "Final" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["refine_text", "chunk_text", "chunk_summary", "chunk_contract"])
def test_text_is_not_shuffled(spark, name):
    # A small table is spread over idle cores by its key; nothing else moves.
    plan = plan_of(spark, name)
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")


def test_scans_are_pruned_and_filtered(spark):
    plan = plan_of(spark, "drop_completed")
    assert "props" not in plan and "value" not in plan
    assert "PushedFilters: [IsNotNull(event_type), In(event_type" in plan


def test_an_answer_log_is_read_once(spark):
    plan = plan_of(spark, "stream_reassembly")
    assert "Join" not in plan and plan.count("Scan parquet") <= 3  # the fixture's union
