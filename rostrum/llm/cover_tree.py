"""Exact near-duplicate vectors by dual traversal of cover trees.

Vectors are taken at length 1, where a cosine of ``s`` is a distance of
``sqrt(2 - 2 * s)``. A tree has nested levels of balls whose radii halve: each ball is
split into balls of at most half its size around members of its own. What prunes are
the radii as measured over all members. Two trees are walked at once, pair of nodes by
pair of nodes:

* balls too far apart for any pair of members go,
* balls so close that all pairs of members are links are counted as a whole, without
  looking at any pair,
* others are opened, and leaves compared in double precision.

Spark lays out the work. Equal vectors of a label are one entry with a weight. The
entries of a label with more than a block of them are dealt to cells, each around one of
up to ``CELLS`` centres (a farthest-first prefix of at most ``FIT_ROWS`` entries chosen
by hash, so a net of the whole table); the radius of a cell is measured over all it
holds. Cells of a label are pairs of nodes like any others: they are pruned, counted
whole, or met block by block in tasks of at most two blocks each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rostrum.llm.common import batch_of, group_starts, groups_in_order, sampled
from rostrum.llm.components import components
from rostrum.operators.lookup import lookup
from rostrum.session import stage

COSINE = 0.93
BLOCK_ROWS = 4_096
FIT_ROWS = 8_192
CELLS = 1_024
LEAF = 64
SLACK = 1e-6  # bounds leave what is so close to the threshold to the exact comparison
_STRIP = 512


def reach(cosine: float) -> float:
    """The distance, at length 1, that a cosine stands for."""
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Tree:
    """Balls over the rows of ``x`` (length 1). The members of node ``i`` are
    ``order[low[i]:high[i]]``, its centre the row ``centre[i]``, one of them; its children
    are the nodes ``first[i]`` to ``last[i] - 1``, none for a leaf. ``loose`` leaves hold
    what no ball of their level took."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, least: float = 0.0) -> None:
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.low, self.high = [], [], [], []
        self.first, self.last, self.loose = [], [], []

        def node(low: int, high: int, centre: int, stays: bool) -> None:
            members = self.order[low:high]
            self.centre.append(centre)
            self.radius.append(float(distances(x[members], x[centre:centre + 1]).max()))
            self.low.append(low)
            self.high.append(high)
            self.first.append(0)
            self.last.append(0)
            self.loose.append(stays)

        node(0, len(x), 0, False)
        i = 0
        while i < len(self.centre):
            low, high, radius = self.low[i], self.high[i], self.radius[i]
            if not self.loose[i] and high - low > leaf and radius > least:
                level = 2.0 ** np.floor(np.log2(radius))
                level = level if level < radius else level / 2
                groups, rest = self._net(self.order[low:high].copy(), self.centre[i], level)
                self.first[i] = len(self.centre)
                for members, centre in groups:
                    self.order[low:low + len(members)] = members
                    node(low, low + len(members), centre, False)
                    low += len(members)
                if len(rest):  # too scattered for balls of this level: compared as it is
                    self.order[low:low + len(rest)] = rest
                    node(low, low + len(rest), int(rest[0]), True)
                self.last[i] = len(self.centre)
            i += 1
        for name in ("centre", "radius", "low", "high", "first", "last", "loose"):
            setattr(self, name, np.array(getattr(self, name)))

    def _net(self, members: np.ndarray, centre: int, level: float):
        """Balls of radius ``level`` around members, the node's own centre first, and the
        members left when an eighth of all have become centres."""
        groups, most = [], max(2, len(members) // 8)
        while len(members) and len(groups) < most:
            near = distances(self.x[members], self.x[centre:centre + 1])[:, 0] <= level
            near |= members == centre
            groups.append((members[near], centre))
            members = members[~near]
            centre = int(members[0]) if len(members) else -1
        return groups, members

    def spread(self, added: np.ndarray) -> np.ndarray:
        """What was added to nodes, per row."""
        steps = np.zeros(len(self.x) + 1)
        np.add.at(steps, self.low, added)
        np.add.at(steps, self.high, -added)
        out = np.zeros(len(self.x))
        out[self.order] = np.cumsum(steps)[:-1]
        return out


def node_pairs(a: Tree, b: Tree, limit: float, same: bool):
    """``(whole pairs, leaf pairs)`` of two trees, or of one with itself (``i <= j``).

    Every pair of rows within ``limit`` lies in exactly one of them; whole pairs hold
    no others.
    """
    apart = distances(a.x[a.centre], b.x[b.centre])
    i = j = np.zeros(1, np.int64)
    whole, leaves = [], []
    while len(i):
        own = (i == j) if same else np.zeros(len(i), bool)
        gap, radii = np.where(own, 0.0, apart[i, j]), a.radius[i] + b.radius[j]
        kept = gap - radii <= limit + SLACK
        i, j, gap, radii, own = i[kept], j[kept], gap[kept], radii[kept], own[kept]
        inside = gap + radii <= limit - SLACK
        whole.append((i[inside], j[inside]))
        i, j, own = i[~inside], j[~inside], own[~inside]
        ends_a, ends_b = a.last[i] == 0, b.last[j] == 0
        done = ends_a & ends_b
        leaves.append((i[done], j[done]))
        # The larger ball is opened, both halves of a node with itself at once.
        open_a = ~done & (own | ~ends_a & (ends_b | (a.radius[i] >= b.radius[j])))
        open_b = ~done & (own | ~open_a)
        n_a = np.where(open_a, a.last[i] - a.first[i], 1)
        n_b = np.where(open_b, b.last[j] - b.first[j], 1)
        count = np.where(done, 0, n_a * n_b)
        at = np.repeat(np.arange(len(i)), count)
        place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        low_a, low_b = np.where(open_a, a.first[i], i), np.where(open_b, b.first[j], j)
        both = own[at]
        i, j = low_a[at] + place // n_b[at], low_b[at] + place % n_b[at]
        ordered = ~both | (i <= j)
        i, j = i[ordered], j[ordered]
    return tuple(np.concatenate([p[k] for p in whole]) for k in (0, 1)), \
        tuple(np.concatenate([p[k] for p in leaves]) for k in (0, 1))


def roots(number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each node reaches over the edges ``a, b``."""
    root = np.arange(number)
    while True:
        one, two = root[a], root[b]
        differ = one != two
        if not differ.any():
            return root
        a, b, one, two = a[differ], b[differ], one[differ], two[differ]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def linked(x: np.ndarray, wx: np.ndarray, y: np.ndarray | None, wy: np.ndarray | None,
           cosine: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """``(weight of the rows each row links with, least row it reaches)`` for the rows of
    ``x`` and then ``y``: links between both, or within ``x`` if there is no ``y``. A row
    doesn't link with itself."""
    limit, same = reach(cosine), y is None
    a = Tree(x, leaf, limit / 16)
    b = a if same else Tree(y, leaf, limit / 16)
    wb = wx if same else wy
    shift = 0 if same else len(x)
    (i, j), (p, q) = node_pairs(a, b, limit, same)
    weights = [np.concatenate([[0.0], np.cumsum(w[t.order])]) for t, w in ((a, wx), (b, wb))]
    heavy_a = weights[0][a.high] - weights[0][a.low]
    heavy_b = weights[1][b.high] - weights[1][b.low]
    add_a, add_b = np.zeros(len(a.centre)), np.zeros(len(b.centre))
    np.add.at(add_a, i, heavy_b[j])
    other = (i != j) if same else np.ones(len(i), bool)
    np.add.at(add_b, j[other], heavy_a[i[other]])
    if same:
        number = len(x)
        links = a.spread(add_a + add_b)
        alone = np.zeros(len(a.centre))
        np.add.at(alone, i[~other], 1.0)
        links -= a.spread(alone) * wx
    else:
        number = len(x) + len(y)
        links = np.concatenate([a.spread(add_a), b.spread(add_b)])
    ends = [(a.centre[i], shift + b.centre[j])]
    for tree, mine, theirs, own, far in (
            (a, i, b.centre[j], 0, shift), (b, j, a.centre[i], shift, 0)):
        at, first = np.unique(mine, return_index=True)
        size = tree.high[at] - tree.low[at]
        place = np.repeat(tree.low[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        ends.append((own + tree.order[place], far + np.repeat(theirs[first], size)))
    by = np.argsort(p, kind="stable")
    p, q = p[by], q[by]
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else []
    for s, e in zip(starts, [*starts[1:], len(p)]):
        mine = a.order[a.low[p[s]]:a.high[p[s]]]
        theirs = np.concatenate([b.order[b.low[k]:b.high[k]] for k in q[s:e]])
        # Within a node with itself each pair is seen from both sides, so counted once.
        own = same and p[s] == q[s:e]
        twice = np.concatenate([np.full(b.high[k] - b.low[k], o) for k, o in zip(
            q[s:e], own if same else np.zeros(e - s, bool))])
        for at in range(0, len(mine), _STRIP):
            rows = mine[at:at + _STRIP]
            hit = x[rows] @ b.x[theirs].T >= cosine
            if same:
                hit &= rows[:, None] != theirs
            links[rows] += hit @ wb[theirs]
            np.add.at(links, shift + theirs[~twice], wx[rows] @ hit[:, ~twice])
            r, c = np.nonzero(hit)
            if len(r) > 2 * (len(rows) + len(theirs)):  # a spanning part of them will do
                root = roots(len(rows) + len(theirs), r, len(rows) + c)
                node = np.concatenate([rows, shift + theirs])
                ends.append((node, node[root]))
            else:
                ends.append((rows[r], shift + theirs[c]))
    return links, roots(number, *(np.concatenate([e[k] for e in ends]) for k in (0, 1)))


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _meet(cosine: float, leaf: int):
    schema = pa.schema([("entry", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_in_order(batches, ["g1", "g2"]):
            starts = [*group_starts(table, ["g1", "g2"]), table.num_rows]
            for s, e in zip(starts, starts[1:]):
                rows = table.slice(s, e - s)
                second = rows.column("second").to_numpy()
                meets = bool(rows.column("meets")[0].as_py())
                ids = rows.column("entry").to_numpy()
                weight = rows.column("weight").to_numpy().astype(float)
                if e - s < 2 or meets and (second.all() or not second.any()):
                    continue
                x = unit(_vectors(rows.column("vector")))
                by = np.lexsort((ids, second))
                ids, x, weight, n = ids[by], x[by], weight[by], int((~second).sum())
                if meets:
                    links, root = linked(x[:n], weight[:n], x[n:], weight[n:], cosine, leaf)
                else:
                    links, root = linked(x, weight, None, None, cosine, leaf)
                got = links > 0
                yield batch_of(schema, ids[got], np.rint(links[got]).astype(np.int64), ids[root[got]])
    return run


def _place(centres: np.ndarray):
    """For ``mapInArrow``: the nearest centre of each vector of a large label, and how far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            large = np.flatnonzero(batch.column("large").to_numpy(zero_copy_only=False))
            if len(large):
                x = unit(_vectors(batch.column("vector").take(pa.array(large))))
                for at in range(0, len(x), _STRIP):
                    d = distances(x[at:at + _STRIP], centres)
                    nearest = d.argmin(axis=1)
                    cell[large[at:at + _STRIP]] = nearest
                    far[large[at:at + _STRIP]] = d[np.arange(len(d)), nearest]
            names = [n for n in batch.schema.names if n != "large"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(cell), pa.array(far)],
                names=[*names, "cell", "far"])
    return run


def farthest_first(x: np.ndarray, number: int) -> np.ndarray:
    """Rows of ``x``, each the farthest from those before it; every prefix is a net."""
    chosen = [0]
    gap = distances(x, x[:1])[:, 0]
    while len(chosen) < min(number, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(x, x[chosen[-1]:chosen[-1] + 1])[:, 0])
    return x[chosen]


def _rows(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """One row per id: ``vec_id, label, vector, usable, f1, f2``."""
    one = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
        F.struct(F.col(f"`{label}`").cast("string").alias("label"),
                 F.col(f"`{vector}`").cast("array<double>").alias("vector")).alias("one"),
    ).where("vec_id is not null").groupBy("vec_id").agg(F.min("one").alias("one"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() \
        & ~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0)
    return one.select("vec_id", "one.*").withColumn(
        "usable", F.coalesce(usable, F.lit(False))).select(
        "*", *[F.xxhash64(F.lit(n), "label", "vector").alias(f"f{n}") for n in (1, 2)])


def _copies(placed: DataFrame, visits: DataFrame) -> DataFrame:
    """Entries of large labels once for each pair of blocks they meet in."""
    partners = visits.select(
        "label", F.col("a").alias("cell"), F.col("blocks_a").alias("mine"),
        F.struct(F.col("b").alias("cell"), F.col("blocks_b").alias("blocks"),
                 F.lit(False).alias("second")).alias("with"),
    ).unionByName(visits.where("a != b").select(
        "label", F.col("b").alias("cell"), F.col("blocks_b").alias("mine"),
        F.struct(F.col("a").alias("cell"), F.col("blocks_a").alias("blocks"),
                 F.lit(True).alias("second")).alias("with"))
    ).groupBy("label", "cell").agg(F.first("mine").alias("mine"), F.collect_list("with").alias("with"))
    joined = lookup(placed.where("cell >= 0"), partners, ["label", "cell"], "entry", "inner")
    met = joined.withColumns({
        "block": F.pmod(F.xxhash64(F.lit(7), "entry"), F.col("mine")).cast("int"),
        "with": F.explode("with")})
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("with.blocks").cast("int") - 1)))
    own = F.col("cell") == F.col("with.cell")
    second = F.when(own, F.col("other") < F.col("block")).otherwise(F.col("with.second"))
    mine = [F.col("cell"), F.col("block")]
    theirs = [F.col("with.cell"), F.col("other")]
    key = [F.when(F.col("second"), t).otherwise(m) for m, t in zip(mine, theirs)] \
        + [F.when(F.col("second"), m).otherwise(t) for m, t in zip(mine, theirs)]
    meets = ~(own & (F.col("block") == F.col("other")))
    return met.withColumn("second", second).select(
        "entry", "weight", "vector", "second", meets.alias("meets"),
        *[F.xxhash64(F.lit(n), "label", *key).alias(f"g{n}") for n in (1, 2)])


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id",
    vector: str = "embedding", label: str = "label", block_rows: int = BLOCK_ROWS,
    cells: int = CELLS, fit_rows: int = FIT_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """One row per id: ``vec_id, n_links, component_id, kept``.

    Two vectors link when their labels are equal and not null and their cosine is at
    least ``cosine``. ``n_links`` counts the other ids linked directly, copies each;
    ``component_id`` is the least id reachable over links, the own one included;
    ``kept`` says whether that is the own one.

    Rows without ``vec_id`` are left out; a row repeated whole is one row, and of rows of
    one id the least (by label, then vector) counts. Vectors that are null, empty or zero
    or hold null or non-finite components link with nothing, nor do those without label or
    of another width than most (ties: the smaller). Other columns are ignored; an empty
    table gives an empty one.
    """
    rows = stage(_rows(vectors, vec_id, vector, label), "vectors")
    width = rows.where("usable").groupBy(F.size("vector").alias("w")).count().orderBy(
        F.desc("count"), "w").first()
    takes_part = F.col("usable") & (F.size("vector") == (width["w"] if width else 0))
    entries = stage(rows.where(takes_part).groupBy("f1", "f2").agg(
        F.min("vec_id").alias("entry"), F.count("*").alias("weight"),
        F.min_by(F.struct("label", "vector"), "vec_id").alias("v"),
    ).select("entry", "weight", "f1", "f2", "v.*"), "entries")
    sizes = entries.groupBy("label").agg(F.count("*").alias("n"))
    large = stage(sizes.where(F.col("n") > block_rows), "large")
    most = large.agg(F.max("n")).first()[0] or 0
    placed = entries.drop("f1", "f2").withColumns(
        {"cell": F.lit(-1), "far": F.lit(0.0)})
    whole = None
    if most:
        sample = sampled(entries.join(large.select("label"), "label", "left_semi"), "entry",
                         fit_rows, large.agg(F.sum("n")).first()[0]).select("vector").toPandas()
        centres = farthest_first(unit(np.stack(sample["vector"].to_numpy()).astype(float)),
                                 min(cells, 2 * -(-most // block_rows)))
        marked = lookup(entries.drop("f1", "f2"), large.select("label", F.lit(True).alias("large")),
                        ["label"], "entry").withColumn("large", F.coalesce("large", F.lit(False)))
        placed = stage(marked.mapInArrow(
            _place(centres),
            "label string, entry long, weight long, vector array<double>, cell int, far double"),
            "placed")
        whole, visits = _cell_pairs(placed, centres, reach(cosine), block_rows)
    small = placed.where("cell < 0").select(
        "entry", "weight", "vector", F.lit(False).alias("second"), F.lit(False).alias("meets"),
        *[F.xxhash64(F.lit(n), "label").alias(f"g{n}") for n in (1, 2)])
    meetings = small if whole is None else small.unionByName(_copies(placed, visits))
    found = stage(
        meetings.repartition("g1", "g2").sortWithinPartitions("g1", "g2")
        .mapInArrow(_meet(cosine, leaf), "entry long, links long, root long"), "links")
    edges = found.select(F.col("entry").alias("a"), F.col("root").alias("b")).where("a != b")
    if whole is not None:
        counted, joints = _whole(placed, whole)
        found = found.unionByName(counted)
        edges = edges.unionByName(joints).unionByName(counted.select(
            F.col("entry").alias("a"), F.col("root").alias("b")).where("a != b"))
    reached = components(edges)
    known = (
        entries.select("f1", "f2", "entry", "weight")
        .join(found.groupBy("entry").agg(F.sum("links").alias("links")), "entry", "left")
        .join(reached.select(F.col("node").alias("entry"), "root"), "entry", "left")
        .select("f1", "f2",
                (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("root", "entry").alias("component_id"))
    )
    mine = lookup(rows.where(takes_part).select("vec_id", "f1", "f2"), known, ["f1", "f2"],
                  "vec_id", "inner").select("vec_id", "n_links", "component_id")
    alone = rows.where(~takes_part).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _cell_pairs(placed: DataFrame, centres: np.ndarray, limit: float, block_rows: int):
    """``(whole, visits)``: pairs of cells of a label all of whose pairs are links, and
    those whose members have to meet. Radii are those of all entries of a cell."""
    spark = placed.sparkSession
    stats = stage(placed.where("cell >= 0").groupBy("label", "cell").agg(
        F.count("*").alias("n"), F.sum("weight").alias("weight"), F.max("far").alias("radius"),
        F.min("entry").alias("rep")), "cells")
    widest = stats.groupBy("cell").agg(F.max("radius").alias("r")).collect()  # one per centre
    radius = np.full(len(centres), -np.inf)
    for r in widest:
        radius[r["cell"]] = r["r"]
    gap = distances(centres, centres)
    np.fill_diagonal(gap, 0.0)
    a, b = np.nonzero(np.triu(gap - radius[:, None] - radius[None, :] <= limit + SLACK))
    near = spark.createDataFrame(
        pa.table({"a": a.astype("i4"), "b": b.astype("i4"), "gap": gap[a, b]}))
    side = {s: stats.select(
        "label", F.col("cell").alias(s), F.ceil(F.col("n") / block_rows).cast("int").alias(f"blocks_{s}"),
        *[F.col(c).alias(f"{c}_{s}") for c in ("weight", "radius", "rep")]) for s in "ab"}
    # At most CELLS ** 2 / 2 pairs of centres, whatever the table.
    pairs = stage(
        side["a"].join(F.broadcast(near), "a").join(side["b"], ["label", "b"])
        .where(F.col("gap") - F.col("radius_a") - F.col("radius_b") <= limit + SLACK), "pairs")
    inside = F.col("gap") + F.col("radius_a") + F.col("radius_b") <= limit - SLACK
    return pairs.where(inside), pairs.where(~inside)


def _whole(placed: DataFrame, whole: DataFrame):
    """Links of entries in cells that link as a whole, and edges that join these cells."""
    def half(mine: str, theirs: str) -> DataFrame:
        return whole.select(
            "label", F.col(mine).alias("cell"), F.col(f"weight_{theirs}").alias("links"),
            F.col(f"rep_{theirs}").alias("root"), (F.col("a") == F.col("b")).cast("int").alias("own"))

    added = half("a", "b").unionByName(half("b", "a").where("own = 0")).groupBy("label", "cell").agg(
        F.sum("links").alias("links"), F.min("root").alias("root"), F.max("own").alias("own"))
    counted = lookup(placed.where("cell >= 0").select("label", "cell", "entry", "weight"), added,
                     ["label", "cell"], "entry", "inner")
    return (
        counted.select("entry", (F.col("links") - F.col("own") * F.col("weight")).alias("links"), "root"),
        whole.where("a != b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")),
    )


#: The query in SQL, pair by pair.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON b.label = a.label AND b.vec_id <> a.vec_id AND len(b.x) = len(a.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a
)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""
