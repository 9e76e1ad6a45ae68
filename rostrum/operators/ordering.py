"""Order-dependent operators that hold when one key owns much of the table.

A window over a key sorts all of its rows in one task. That is right for keys
of ordinary size and fails for a hot one, so keys above ``rows_per_task`` are
found first and take a range-partitioned path whose tasks are cut by order, not
by key. Both paths give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rostrum.session import stage

ROWS_PER_TASK = 250_000


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more rows than one task should sort, as a written table ``_hot``.

    Reads the key column only. The driver sees none of the keys, and there may
    be any number of them.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    return stage(
        counts.where(F.col("_n") > rows_per_task).select(F.col(key).alias("_hot")), "hot-keys"
    )


def split_hot(
    df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK, counted: DataFrame | None = None
):
    """``(ordinary rows, hot rows or None)``.

    ``counted`` may hold more rows than ``df`` when it is cheaper to count, as a
    table is before a filter that reads its texts.

    The table of hot keys is small, so the size of its files lets Spark
    broadcast it; if it is not, AQE splits the skewed side of the join.
    """
    hot = hot_keys(counted if counted is not None else df, key, rows_per_task)
    if hot.isEmpty():
        return df, None
    member = F.col(key).eqNullSafe(F.col("_hot"))
    return df.join(hot, member, "left_anti"), df.join(hot, member, "left_semi")


def _number_by_range(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    placed = stage(
        df.repartitionByRange(key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_range", F.shiftright("_at", 33))
    # One row per key and range: a key has no more of them than there are tasks.
    spans = placed.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = Window.partitionBy("_key").orderBy("_r").rowsBetween(
        Window.unboundedPreceding, -1
    )
    spans = spans.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    return (
        placed.join(spans, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
        .drop("_at", "_range", "_key", "_r", "_first", "_rows", "_before")
    )


def number_rows(
    df: DataFrame, key: str, order: list[str], name: str = "n",
    rows_per_task: int = ROWS_PER_TASK, counted: DataFrame | None = None,
) -> DataFrame:
    """Adds the 1-based position of each row within its key.

    ``order`` must be total within a key. ``counted``: see ``split_hot``.
    """
    ordinary, hot = split_hot(df, key, rows_per_task, counted)
    window = Window.partitionBy(key).orderBy(*order)
    numbered = ordinary.withColumn(name, F.row_number().over(window).cast("bigint"))
    if hot is None:
        return numbered
    return numbered.unionByName(_number_by_range(hot, key, order, name).select(*numbered.columns))


def with_next(
    df: DataFrame, key: str, order: list[str], columns: list[str], prefix: str = "next_",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds ``columns`` of the row that follows within the key; null on the last."""
    ordinary, hot = split_hot(df, key, rows_per_task)
    window = Window.partitionBy(key).orderBy(*order)
    result = ordinary.select(
        "*", *[F.lead(c).over(window).alias(prefix + c) for c in columns]
    )
    if hot is None:
        return result
    # Staged, since both sides of the join need the same numbers.
    numbered = stage(_number_by_range(hot, key, order, "_n"), "followed")
    following = numbered.select(
        F.col(key).alias("_key"), (F.col("_n") - 1).alias("_m"),
        *[F.col(c).alias(prefix + c) for c in columns],
    )
    paired = numbered.join(
        following,
        F.col(key).eqNullSafe(F.col("_key")) & (F.col("_n") == F.col("_m")),
        "left",
    )
    return result.unionByName(paired.select(*result.columns))
