"""Rows that operators once passed over, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from rostrum.llm import line_dedup, packing, toxicity


def one_word_edit(a, b):
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def test_short_lines(spark):
    rng = random.Random(7)
    lines = [[f"{c}{k}" for k in range(n)] for c, n in zip("abcdefgh", (2, 3, 4, 5, 6, 7, 8, 9))]
    for _ in range(150):
        w = list(rng.choice(lines))
        k = rng.randrange(len(w))
        w[k:k + rng.choice([0, 1])] = rng.choice([[], ["z"], ["y"], [w[k]], ["y", "q"]])
        lines.append(w or ["x"])
    rng.shuffle(lines)
    kept, seen = [], []
    for k, w in enumerate(lines):
        if w not in seen and not any(
                len(w) >= 4 and len(x) >= 4 and one_word_edit(w, x) for x in seen):
            kept.append(k)
        if w not in seen:
            seen.append(w)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(lines)],
                               "doc_id long, text string")
    got = sorted(r.doc_id for r in line_dedup.line_report(df).collect() if r.n_kept)
    assert got == kept


def test_sweeps_end_at_the_least_residual():
    rng = np.random.default_rng(5)
    window = 64
    counts = rng.integers(0, 400, window)
    counts[0] = 0
    rows = packing.combinations(window, counts)

    def taken(x):
        used = np.bincount(rows.ravel(), np.repeat(x, 3), window)
        used[0] = 0
        assert (used <= counts).all()
        return used.sum() / counts.sum()

    near, close = (taken(packing.repeats(rows, counts, t)) for t in (packing.TOLERANCE, 1e-9))
    assert near > close - 0.02
    assert near > taken(packing.repeats(rows, counts, 1.0)) + 0.02


def test_fit_sample(spark):
    train = spark.range(0, 5000, 1, 8).select(
        F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit(1).alias("label"))
    sample = toxicity.fit_sample(train, 700)
    want = train.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(700)
    assert sorted(sample.collect()) == sorted(want.collect())
    assert sample.select(F.spark_partition_id().alias("p")).distinct().count() == 8
    assert toxicity.fit_sample(train, 5000).count() == 5000
