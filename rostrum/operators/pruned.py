"""Exact top-k search that skips blocks of vectors by the triangle inequality on angles.

A large meeting is dealt to cells around pivots, vectors of its own chosen by hash. A cell
of more than a block's rows is cut further: by order where only earlier candidates count,
by hash elsewhere. A block is known by its pivot and its radius, the largest angle between
the pivot and a row of it.

Prompts form blocks too. A block of prompts first meets the candidate blocks nearest to it
that hold enough rows, which gives each prompt a k-th score. Angles obey the triangle
inequality, so no row of another block can be nearer to any of the prompts than the angle
between the pivots less both radii. Where that angle's cosine lies below the least k-th
score, the pair of blocks is skipped; the others are multiplied as matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rostrum.functions.vectors import cosine, l2_norm
from rostrum.limits import VECTOR_WIDTH
from rostrum.operators.lookup import lookup
from rostrum.operators.retrieval import BLOCK_ROWS, block_hits, block_side, top_similar
from rostrum.session import stage

PIVOTS = 256  # of a meeting, at most
PARTS = 16  # of a meeting, as long as they hold no more than ``BLOCK_ROWS`` rows
CUTS = 64  # quantiles of the order that a cell may be cut at
SLACK = 2e-6  # more than scores lose when they are rounded


def _nearest(schema: pa.Schema):
    """Rows of a part of a meeting with the pivot nearest to each, and the angle to it."""
    def place(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not len(rows) or not len(pivots):
            return schema.empty_table()

        def unit(column: pa.ChunkedArray) -> np.ndarray:
            x = np.array(column.combine_chunks().flatten(), dtype=float).reshape(len(column), -1)
            return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

        near = np.clip(unit(rows["_val"]) @ unit(pivots["_pivot"]).T, -1.0, 1.0)
        at = near.argmax(axis=1)
        numbers = pivots["_cell"].to_numpy()[at]
        angles = np.arccos(near[np.arange(len(at)), at])
        own = rows.drop_columns("_part")
        return pa.table([*own.columns, pa.array(numbers), pa.array(angles)], schema=schema)
    return place


def _placed(side: DataFrame, ident: str, pivots: DataFrame, sizes: DataFrame, count: str) -> DataFrame:
    """``side`` with ``_cell`` and ``_angle``; a task sees a block of rows and the pivots."""
    parts = sizes.select("job", F.col(count).alias("_parts"))
    rows = lookup(side, parts, ["job"], ident, "inner", stored=True).withColumn(
        "_part", F.pmod(F.xxhash64(F.lit(5), ident), F.col("_parts"))).drop("_parts")
    each = pivots.join(parts, "job").select(
        "job", "_cell", "_pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"))
    out = T.StructType([*[f for f in rows.schema if f.name != "_part"],
                        T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())])
    return rows.groupBy("job", "_part").cogroup(each.groupBy("job", "_part")).applyInArrow(
        _nearest(to_arrow_schema(out)), out)


def _cut(placed: DataFrame, ident: str, sizes: DataFrame, ordered: bool) -> DataFrame:
    """Adds ``_sub``, the block of a row within its cell."""
    sizes, blocks = sizes.select("job", "_rows"), F.ceil(F.col("_n") / F.col("_rows"))
    if not ordered:
        n = placed.groupBy("job", "_cell").agg(F.count("*").alias("_n"))
        cut = lookup(placed, n.join(sizes, "job"), ["job", "_cell"], ident, "inner")
        return cut.withColumn("_sub", F.pmod(F.xxhash64(F.lit(6), ident), blocks).cast("int")).drop("_n", "_rows")
    shares = [(i + 1) / CUTS for i in range(CUTS - 1)]
    # Cuts are found on the order as text would not be: the order columns are numbers or times.
    as_number = _number(F.col("_ord"), placed.schema["_ord"].dataType)
    n = placed.groupBy("job", "_cell").agg(
        F.count("*").alias("_n"),
        F.percentile_approx(as_number, shares, F.lit(1000)).alias("_cuts"))
    cut = lookup(placed, n.join(sizes, "job"), ["job", "_cell"], ident, "inner")
    passed = F.size(F.filter("_cuts", lambda c: c < as_number))
    return cut.withColumn("_sub", F.floor(passed * F.least(blocks, F.lit(CUTS)) / CUTS).cast("int")).drop(
        "_n", "_cuts", "_rows")


def _number(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(column.cast("timestamp"))
    return column.cast("double")


def _blocks(rows: DataFrame, side: str, ordered: bool) -> DataFrame:
    first, last = [F.min("_ord").alias(f"low_{side}")], [F.max("_ord").alias(f"high_{side}")]
    return rows.groupBy("job", F.col("_cell").alias(f"cell_{side}"), F.col("_sub").alias(f"sub_{side}")).agg(
        F.count("*").alias(f"n_{side}"), F.max("_angle").alias(f"radius_{side}"),
        *((first + last) if ordered else []))


_PAIR = ["job", "cell_p", "sub_p", "cell_c", "sub_c"]


def top_pruned(
    prompts: DataFrame, candidates: DataFrame, k: int, *, job: str, prompt_id: str,
    candidate_id: str, vector: str = "vector", prompt_order: str | None = None,
    candidate_order: str | None = None, exclude_self: bool = False, size: int = VECTOR_WIDTH,
    block_rows: int = BLOCK_ROWS, visited: dict | None = None,
) -> DataFrame:
    """``job, prompt_id, candidate_id, rank, score``, as ``retrieval.top_similar`` gives it
    for dense vectors.

    Meetings of up to ``block_rows`` rows are one block and are left to ``top_similar``. The
    blocks of a larger one hold a ``PARTS``-th of its rows if that is more, up to
    ``BLOCK_ROWS``: pairs of blocks, and copies of a row, don't grow with its square.
    ``visited`` gets, if given, the numbers of block pairs of the larger ones: ``all``,
    ``first`` and ``second``.
    """
    spark, ordered = prompts.sparkSession, prompt_order is not None
    left = block_side(prompts, job, prompt_id, "prompt_id", vector, prompt_order, False)
    right = block_side(candidates, job, candidate_id, "candidate_id", vector, candidate_order, False)
    good = lambda side: side.where((F.size("_val") == size) & l2_norm(F.col("_val")).between(1e-300, 1e300))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    counts = left.select("job", one.alias("p"), none.alias("c")).unionByName(
        right.select("job", none.alias("p"), one.alias("c"))).groupBy("job").agg(
        F.sum("p").alias("p"), F.sum("c").alias("c"))
    most = F.greatest("p", "c")
    rows_of = F.greatest(F.lit(block_rows), F.least(F.lit(BLOCK_ROWS), F.ceil(most / PARTS)))
    large = stage(counts.where((most > block_rows) & (F.col("p") > 0)).withColumn("_rows", rows_of).select(
        "job", "_rows", *[F.ceil(F.greatest(F.col(s), one) / F.col("_rows")).alias(f"parts_{s}") for s in "pc"]), "large")
    kept = dict(job=job, prompt_id=prompt_id, candidate_id=candidate_id, vector=vector,
                prompt_order=prompt_order, candidate_order=candidate_order,
                exclude_self=exclude_self, size=size)
    if large.isEmpty():
        return top_similar(prompts, candidates, k, **kept)
    names = large.select(F.col("job").alias(job))
    others = top_similar(lookup(prompts, names, [job], prompt_id, "left_anti", stored=True),
                         lookup(candidates, names, [job], candidate_id, "left_anti", stored=True), k, **kept)

    inside = lambda side, ident: good(lookup(side, large.select("job"), ["job"], ident, "left_semi", stored=True))
    left, right = inside(left, "prompt_id"), inside(right, "candidate_id")
    chosen = Window.partitionBy("job").orderBy(F.xxhash64(F.lit(4), "candidate_id"), "candidate_id")
    first = right.select("job", "candidate_id").withColumn("n", F.row_number().over(chosen)).where(
        F.col("n") <= PIVOTS).join(large, "job").where(F.col("n") <= F.col("parts_c"))
    pivots = stage(lookup(right, first.select("job", "candidate_id", "n"), ["job", "candidate_id"], "candidate_id", "inner")
                   .select("job", (F.col("n") - 1).alias("_cell"), F.col("_val").alias("_pivot"))
                   .dropDuplicates(["job", "_cell"]), "pivots")
    p = stage(_cut(_placed(left, "prompt_id", pivots, large, "parts_p"), "prompt_id", large, ordered), "prompts")
    c = stage(_cut(_placed(right, "candidate_id", pivots, large, "parts_c"), "candidate_id", large, ordered),
              "candidates")
    gaps = pivots.select("job", F.col("_cell").alias("cell_p"), F.col("_pivot").alias("a")).join(
        pivots.select("job", F.col("_cell").alias("cell_c"), F.col("_pivot").alias("b")), "job").select(
        "job", "cell_p", "cell_c", F.when(F.col("cell_p") == F.col("cell_c"), 0.0).otherwise(
            F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("a"), F.col("b")))))).alias("gap"))
    pairs = gaps.join(_blocks(p, "p", ordered), ["job", "cell_p"]).join(
        _blocks(c, "c", ordered), ["job", "cell_c"])
    if ordered:  # no row of the block can lie before a prompt of the other
        pairs = pairs.where(F.col("low_c") < F.col("high_p"))
    pairs = stage(pairs.select(*_PAIR, "n_c", F.greatest(
        F.lit(0.0), F.col("gap") - F.col("radius_p") - F.col("radius_c")).alias("nearest"), "gap"), "pairs")
    enough = Window.partitionBy("job", "cell_p", "sub_p").orderBy(
        "nearest", "gap", "cell_c", "sub_c").rowsBetween(Window.unboundedPreceding, -1)
    marked = stage(pairs.withColumn("first", F.coalesce(F.sum("n_c").over(enough), F.lit(0)) < k + exclude_self),
                   "marked")
    result = T.StructType([
        T.StructField("job", left.schema["job"].dataType),
        T.StructField("prompt_id", left.schema["prompt_id"].dataType),
        T.StructField("candidate_id", right.schema["candidate_id"].dataType),
        T.StructField("score", T.DoubleType())])
    kernel = block_hits(k, size, False, ordered, exclude_self, to_arrow_schema(result))

    def met(some: DataFrame) -> DataFrame:
        """Hits of the pairs of blocks in ``some``: both sides' rows once per pair."""
        def rows(side: DataFrame, mine: str, ident: str) -> DataFrame:
            own = [F.col("_cell").alias(f"cell_{mine}"), F.col("_sub").alias(f"sub_{mine}")]
            theirs = "c" if mine == "p" else "p"
            with_ = some.groupBy("job", f"cell_{mine}", f"sub_{mine}").agg(
                F.collect_list(F.struct(f"cell_{theirs}", f"sub_{theirs}")).alias("_with"))
            columns = ["job", ident, "_val", *(["_ord"] if ordered else [])]
            joined = lookup(side.select(*columns, *own), with_, ["job", f"cell_{mine}", f"sub_{mine}"], ident, "inner")
            return joined.select("*", F.inline("_with")).select(
                *columns, F.xxhash64(*_PAIR).alias("_pair"))
        return rows(p, "p", "prompt_id").groupBy("_pair").cogroup(
            rows(c, "c", "candidate_id").groupBy("_pair")).applyInArrow(kernel, result)

    best = Window.partitionBy("job", "prompt_id").orderBy(F.desc("score"), "candidate_id")
    early = stage(met(marked.where("first")), "first_hits")
    kth = early.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select(
        "job", "prompt_id", F.col("score").alias("kth"))
    # A prompt without k hits keeps its block open for everything.
    least = p.select("job", "prompt_id", F.col("_cell").alias("cell_p"), F.col("_sub").alias("sub_p")).join(
        kth, ["job", "prompt_id"], "left").groupBy("job", "cell_p", "sub_p").agg(
        F.min(F.coalesce("kth", F.lit(-2.0))).alias("least"))
    rest = stage(marked.where(~F.col("first")).join(least, ["job", "cell_p", "sub_p"]).where(
        F.cos("nearest") >= F.col("least") - SLACK), "rest")
    if visited is not None:
        visited |= {"all": marked.count(), "first": marked.where("first").count(), "second": rest.count()}
    hits = early.unionByName(met(rest)).dropDuplicates(["job", "prompt_id", "candidate_id"])
    found = hits.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k).select(
        F.col("job").alias(job), "prompt_id", "candidate_id", "rank", "score")
    return found.unionByName(others.select(*found.columns))
