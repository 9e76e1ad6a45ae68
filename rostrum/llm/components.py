"""Connected components of a distributed graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rostrum.session import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; the root is the least node.

    Each round hangs the larger neighbours of a node on its least neighbour,
    then the smaller ones likewise (large star, small star), and is written to
    the shared folder, so a lost executor costs one round at most. It ends when
    a round changes nothing: then every edge leads to its root. Only two sums
    come to the driver. Nulls and loops are left out.
    """
    hung = stage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = _state(hung)
    while True:
        both = hung.union(hung.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(
            F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(root, "a").where("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(root)
        )
        hung = stage(small.distinct(), "edges")
        now = _state(hung)
        if now == before:
            break
        before = now
    return hung.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        hung.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
