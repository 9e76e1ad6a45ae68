"""Cover trees against brute force: links, components, pruning, odd rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rostrum.llm import cover_tree

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(rng, n, width=16, spread=0.08):
    """Tight groups, a chain, copies and noise, in random order."""
    centres = rng.normal(size=(6, width))
    parts = [c + spread * np.linalg.norm(c) / np.sqrt(width) * rng.normal(size=(n // 12, width))
             for c in centres]
    steps = np.cumsum(0.25 * rng.normal(size=(n // 6, width)), axis=0) + 3 * centres[0]
    x = np.concatenate([*parts, steps, rng.normal(size=(n // 3, width))])
    x = np.concatenate([x, x[: n // 20], x[: n // 20] * 2])  # copies, and longer ones
    return x[rng.permutation(len(x))].astype("f4").astype(float)


def brute(ids, x, labels, cosine=0.93):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    root = np.array(ids)
    while True:
        least = np.minimum(root, np.where(hit, root[None, :], root.max() + 1).min(axis=1))
        if (least == root).all():
            break
        root = least
    return {i: (int(n), int(r), bool(i == r)) for i, n, r in zip(ids, hit.sum(axis=1), root)}


def got(df, **settings):
    return {r.vec_id: (r.n_links, r.component_id, r.kept)
            for r in cover_tree.near_duplicates(df, **settings).collect()}


@pytest.mark.parametrize("leaf", [1, 8, 64])
def test_two_trees(leaf):
    rng = np.random.default_rng(leaf)
    for _ in range(12):
        x = cover_tree.unit(clustered(rng, int(rng.integers(40, 400))))
        w = rng.integers(1, 4, len(x)).astype(float)
        hit = x @ x.T >= 0.93
        cut = int(rng.integers(1, len(x) - 1))
        links, root = cover_tree.linked(x[:cut], w[:cut], x[cut:], w[cut:], 0.93, leaf)
        across = hit.copy()
        across[:cut, :cut] = across[cut:, cut:] = False
        assert (links == across @ w).all()
        assert (root == cover_tree.roots(len(x), *np.nonzero(across))).all()
        np.fill_diagonal(hit, False)
        links, root = cover_tree.linked(x, w, None, None, 0.93, leaf)
        assert (links == hit @ w).all()
        assert (root == cover_tree.roots(len(x), *np.nonzero(hit))).all()


def test_radii_cover_and_halve():
    x = cover_tree.unit(clustered(np.random.default_rng(3), 600))
    tree = cover_tree.Tree(x, 4)
    for i in range(len(tree.centre)):
        members = tree.order[tree.low[i]:tree.high[i]]
        assert tree.centre[i] in members
        far = cover_tree.distances(x[members], x[tree.centre[i]:tree.centre[i] + 1]).max()
        assert far <= tree.radius[i] + 1e-12
        children = range(tree.first[i], tree.last[i])
        if children:
            assert sum(tree.high[c] - tree.low[c] for c in children) == len(members)
            level = 2.0 ** (np.ceil(np.log2(tree.radius[i])) - 1)  # the next halving below
            assert all(tree.radius[c] <= level + 1e-12 for c in children if not tree.loose[c])


def test_pairs_of_nodes_are_pruned_and_counted_whole():
    """A tight group and far noise: few pairs of rows are ever compared."""
    rng = np.random.default_rng(5)
    tight = np.ones(64) + 0.05 * rng.normal(size=(2000, 64))
    x = cover_tree.unit(np.concatenate([tight, -np.ones(64) + 0.05 * rng.normal(size=(2000, 64))]))
    tree = cover_tree.Tree(x, 64, cover_tree.reach(0.93) / 16)
    (i, j), (p, q) = cover_tree.node_pairs(tree, tree, cover_tree.reach(0.93), True)
    size = tree.high - tree.low
    assert (size[p] * size[q]).sum() < 0.01 * len(x) ** 2
    pairs = np.where(i == j, size[i] * (size[i] - 1) // 2, size[i] * size[j]).sum()
    assert pairs == 2 * (2000 * 1999 // 2)


@pytest.mark.parametrize("block,cells", [(4096, 1024), (60, 8), (25, 40)])
def test_tables(spark, block, cells):
    rng = np.random.default_rng(block)
    x = clustered(rng, 500)
    labels = rng.choice([0, 0, 0, 1, 2], len(x))
    ids = rng.permutation(len(x)) + 10
    df = spark.createDataFrame(pd.DataFrame(
        {"vec_id": ids, "embedding": x.tolist(), "label": labels}), SCHEMA)
    want = brute(ids, x, labels)
    assert got(df, block_rows=block, cells=cells) == want
    assert sum(n for n, _, _ in want.values()) > 1000


def test_a_tight_group_over_cells(spark):
    """Two thirds of the rows in one group of near copies, a third of them equal."""
    rng = np.random.default_rng(2)
    group = np.ones(8) + 0.02 * rng.normal(size=(200, 8))
    group[:100] = group[0]
    x = np.concatenate([group, rng.normal(size=(100, 8))]).astype("f4").astype(float)
    ids, labels = np.arange(300), np.zeros(300, int)
    df = spark.createDataFrame(pd.DataFrame(
        {"vec_id": ids, "embedding": x.tolist(), "label": labels}), SCHEMA)
    assert got(df, block_rows=20, cells=10) == brute(ids, x, labels)


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.01], 0), (2, [2.0, 0.01], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None),
        (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [1.0, None], 0), (9, [1.0, float("nan")], 0),
        (10, [float("inf"), 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0),
        (12, [3e38, 0.0], 0), (13, [1e-38, 0.0], 0), (14, [1.0, 0.0], 2), (14, [0.0, 1.0], 2),
        (15, [0.0, 1.0], 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"entry": F.lit("x"), "cell": F.lit(1), "f1": F.lit(2), "Root": F.lit(3)})
    want = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)}
    want |= {1: (3, 1, True), 2: (3, 1, False), 12: (3, 1, False), 13: (3, 1, False),
             14: (1, 14, True), 15: (1, 14, False)}
    for block in (4096, 1):
        assert got(df, block_rows=block) == want
    assert got(df.limit(0)) == {}
    assert got(df.where("vec_id = 5")) == {5: (0, 5, True)}
