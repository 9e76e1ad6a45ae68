"""Ball k-means against plain k-means, and its tables on odd rows."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rostrum.llm import ball_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(points, book):
    d = ((points[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def brute(ids, x, labels, parts=8, entries=16, rounds=6):
    v = np.floor(4096 * x.astype(float)).astype(np.int64).reshape(len(x), parts, -1)
    book = v[np.argsort(ids)[:entries]].swapaxes(0, 1).copy()
    for n in range(rounds + 1):
        codes, far = zip(*(plain(v[:, p], book[p]) for p in range(parts)))
        if n < rounds:
            for p in range(parts):
                for e in range(book.shape[1]):
                    mine = v[codes[p] == e, p]
                    if len(mine):
                        book[p, e] = [sum(c) // len(mine) for c in zip(*mine.tolist())]
    error = np.sum(far, axis=0)
    text = ",".join(str(c) for p in book for e in p for c in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return {i: ("".join(f"{c[k]:02x}" for c in codes), int(error[k]),
                int(error[labels == labels[k]].sum()), digest) for k, i in enumerate(ids)}


def got(df, **settings):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256)
            for r in ball_codes.compressed(df, **settings).collect()}


@pytest.mark.parametrize("reach", [3, 40, 5000])
def test_nearest_is_exact(reach):
    """Small numbers tie often; equal entries and any start."""
    rng = np.random.default_rng(reach)
    for _ in range(60):
        width, n = int(rng.integers(1, 9)), int(rng.integers(1, 300))
        points = rng.integers(-reach, reach + 1, (n, width))
        book = rng.integers(-reach, reach + 1, (int(rng.integers(1, 17)), width))
        book = np.concatenate([book, book[:1]])
        start = rng.integers(0, len(book), n)
        codes, far = ball_codes.nearest(points, start, book)
        want, least = plain(points, book)
        assert (codes == want).all() and (far == least).all()


def test_cores_and_rings_skip_work():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (16, 8))
    points = centres[rng.integers(0, 16, 20_000)] + rng.integers(-150, 151, (20_000, 8))
    codes, _ = plain(points, centres)
    work = {}
    ball_codes.nearest(points, codes, centres, work)
    assert work["stable"] > 0.9 * len(points) and work["compared"] < 0.02 * 15 * len(points)


def test_tables(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(400, 32)) / 4).astype("f4")
    x[200:300] = x[0]
    ids, labels = rng.permutation(400) * 3, rng.integers(0, 4, 400)
    df = spark.createDataFrame(pd.DataFrame(
        {"vec_id": ids, "embedding": x.tolist(), "label": labels}), SCHEMA)
    want = brute(ids, x, labels)
    assert got(df.repartition(7)) == want
    assert got(df.where("vec_id < 30")) == brute(
        *(a[ids < 30] for a in (ids, x, labels)))  # fewer rows than entries


def test_odd_rows(spark):
    rows = [(1, [0.5, -0.25], 0), (2, [0.1, 1e9], None), (2, [0.1, 1e9], None), (3, None, 0), (4, [], 0),
            (5, [1.0, None], 0), (6, [float("nan"), 1.0], 0), (7, [float("inf"), 1.0], 0),
            (None, [0.25, 0.25], 1), (8, [1.0, 2.0, 3.0], 0), (9, [-0.5, 0.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"parts": F.lit("x"), "error": F.lit(1), "Sums": F.lit(2), "codes": F.lit(3)})
    out = ball_codes.compressed(df, parts=2, entries=2).collect()
    assert sorted(r.vec_id or 0 for r in out) == [0, 1, 2, 2, 9]
    twice = [r for r in out if r.vec_id == 2]
    assert twice[0] == twice[1] and all(r.label_error >= 2 * twice[0].error for r in twice)
    assert len({r.codebooks_sha256 for r in out}) == 1
    padded = ball_codes.compressed(df, parts=4).collect()
    assert {len(r.code) for r in padded} == {8}
    assert ball_codes.compressed(df.limit(0)).count() == 0
    assert ball_codes.compressed(df.where("vec_id = 3")).count() == 0
