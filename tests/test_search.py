"""Searches that skip what can't matter give what the full search gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.functions.vectors import FEATURES
from rostrum.operators import postings, pruned, retrieval


def rows_of(df):
    return sorted(map(tuple, df.select("job", "prompt_id", "candidate_id", "rank", "score").collect()))


@pytest.fixture(scope="module")
def texts(spark):
    """A large meeting of texts with common and rare buckets, small ones, texts without any."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        job = "hot" if i % 3 else f"j{i % 60}"
        topic = rng.randrange(20)
        words = [rng.choice([1, 2, 3]) for _ in range(rng.randrange(0, 4))]
        words += [10 + topic * 7 + rng.randrange(7) for _ in range(rng.randrange(0, 9))]
        rows.append((job, i, [(b, words.count(b)) for b in sorted(set(words))]))
    rows += [(None, 2000, [(1, 1)]), ("hot", 2001, None), ("hot", 2002, []), ("lone", 2003, [(5, 2)])]
    return spark.createDataFrame(rows, f"job string, id int, vector {FEATURES}").withColumn("n", F.lit(7))


@pytest.mark.parametrize("per_block,rounds,rows_per_task", [(64, 5, 250_000), (4, 8, 50), (2, 1, 250_000), (3, 3, 9)])
def test_index_equals_full_search(texts, per_block, rounds, rows_per_task):
    asked = texts.where("id % 4 = 0 or id > 1999")
    names = {"job": "job", "prompt_id": "id", "candidate_id": "id"}
    lists = postings.posting_lists(texts, "job", "id", per_block=per_block, rows_per_task=rows_per_task)
    got = postings.top_by_index(asked, texts, lists, 5, rounds=rounds, **names)
    want = retrieval.top_similar(asked, texts, 5, **names)
    assert rows_of(got) == rows_of(want)


def test_postings_are_left_unread(spark, texts):
    lists = postings.posting_lists(texts, "job", "id", per_block=4)
    asked = texts.where("job = 'hot' and size(vector) > 5")
    read = []
    postings.top_by_index(asked, texts, lists, 3, job="job", prompt_id="id", candidate_id="id",
                          rounds=8, read=read).collect()
    all_ = asked.select("job", F.explode("vector.bucket").alias("bucket")).join(lists, ["job", "bucket"]).count()
    assert len(read) > 1 and 0 < sum(read) < 0.6 * all_


def test_lists_are_ordered_by_weight(texts):
    lists = postings.posting_lists(texts, "job", "id", per_block=4).collect()
    by = {(r.job, r.bucket, r.block): r for r in lists}
    assert all(len(r.ids) <= 4 for r in lists)
    for (job, bucket, block), r in by.items():
        assert block == 0 or by[job, bucket, block - 1].bound >= r.bound


def test_nothing_asked_or_found(spark, texts):
    lists = postings.posting_lists(texts, "job", "id")
    names = {"job": "job", "prompt_id": "id", "candidate_id": "id"}
    assert postings.top_by_index(texts.limit(0), texts, lists, 5, **names).count() == 0
    none = texts.limit(0)
    assert postings.top_by_index(texts, none, postings.posting_lists(none, "job", "id"), 5, **names).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    """A large meeting of a few tight groups, small ones, rows that can't be compared."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 600)] + 0.05 * rng.normal(size=(600, 8))
    x[:5] = x[5]
    rows = [("hot" if i % 4 else f"j{i % 24}", i, int(rng.integers(0, 400)), v.tolist()) for i, v in enumerate(x)]
    rows += [("hot", 900, 5, None), ("hot", 901, 5, []), ("hot", 902, 5, [0.0] * 8), (None, 903, 5, [1.0] * 8),
             ("hot", 904, 5, [float("nan")] * 8), ("lone", 905, 5, [1.0] * 8)]
    return spark.createDataFrame(rows, "job string, id int, said int, vector array<double>").withColumn(
        "_cell", F.lit("x"))


@pytest.mark.parametrize("block", [20, 64, 4096])
@pytest.mark.parametrize("order,self_", [(None, True), (None, False), ("said", False)])
def test_pruned_equals_full_search(vectors, block, order, self_):
    settings = dict(job="job", prompt_id="id", candidate_id="id", prompt_order=order, candidate_order=order,
                    exclude_self=self_, size=8)
    asked = vectors.where("id % 2 = 0")
    got = pruned.top_pruned(asked, vectors, 4, block_rows=block, **settings)
    assert rows_of(got) == rows_of(retrieval.top_similar(asked, vectors, 4, **settings))


def test_block_pairs_are_skipped(vectors):
    seen = {}
    pruned.top_pruned(vectors, vectors, 4, job="job", prompt_id="id", candidate_id="id", size=8,
                      exclude_self=True, block_rows=30, visited=seen)
    assert seen["all"] > 100 and seen["first"] + seen["second"] < 0.5 * seen["all"]


def test_block_pairs_do_not_grow_with_the_square_of_a_meeting(spark):
    x = np.random.default_rng(6).normal(size=(1500, 4))
    rows = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "job long, id int, vector array<double>")
    settings, seen = dict(job="job", prompt_id="id", candidate_id="id", exclude_self=True, size=4), {}
    got = pruned.top_pruned(rows, rows, 3, block_rows=4, visited=seen, **settings)
    assert seen["all"] <= (2 * pruned.PARTS) ** 2
    assert rows_of(got) == rows_of(retrieval.top_similar(rows, rows, 3, **settings))
