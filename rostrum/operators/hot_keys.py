"""Which keys are hot, from sketches of one pass, and how many salts each of them needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PIECES = 8  # a shuffle partition should hold the rows of about so many pieces
MOST_PIECES = 8192  # bounds the sketches and the table of hot keys
_HASH, _SALTS = "_key_hash", "_salts"


def key_hash(keys: list[str]) -> Column:
    """Keys of any width as one number. Two keys that share it share their salts, no more."""
    return F.xxhash64(*keys)


def hot_salts(facts: DataFrame, keys: list[str], parts: int | None = None) -> list[tuple[int, int]]:
    """``(hash of the key, salts)`` of the keys that hold more than a piece of the rows.

    A piece is the ``PIECES``-th part of what a shuffle partition holds on average, and not
    less than the ``MOST_PIECES``-th part of the rows, so fewer than ``MOST_PIECES`` keys can
    be hot. They come from a frequent-items sketch, their counts from a count-min sketch,
    which never counts too little; both are merged from one state a task, of a size that
    doesn't depend on the rows. A wrong estimate costs balance, never a row.
    """
    spark = facts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = min(PIECES * parts, MOST_PIECES)
    found = facts.select(key_hash(keys).alias("_h")).agg(
        F.count("*").alias("rows"),
        F.call_function("approx_top_k", "_h", F.lit(pieces), F.lit(8 * pieces)).alias("top"),
        F.count_min_sketch("_h", F.lit(1.0 / (4 * pieces)), F.lit(0.99), F.lit(7)).alias("counts"),
    ).first()
    if not found.rows:
        return []
    counts = spark.sparkContext._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(found.counts)
    piece = -(-found.rows // pieces)
    likely = {t["item"]: counts.estimateCount(t["item"]) for t in found.top}
    return sorted((h, -(-n // piece)) for h, n in likely.items() if n > piece)


def salted(facts: DataFrame, dim: DataFrame, keys: list[str], spread: str,
           hot: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt``: a hot key's facts are dealt by ``spread`` over its
    salts and its row of ``dim`` is copied once per salt; all else has salt 0 and one copy."""
    table = dim.sparkSession.createDataFrame(hot, f"{_HASH} long, {_SALTS} int")

    def known(rows: DataFrame) -> DataFrame:  # fewer than MOST_PIECES rows are broadcast
        marked = rows.withColumn(_HASH, key_hash(keys)).join(F.broadcast(table), _HASH, "left")
        return marked.withColumn(_SALTS, F.coalesce(_SALTS, F.lit(1))).drop(_HASH)

    dealt = known(facts).withColumn("_salt", F.pmod(F.xxhash64(spread), F.col(_SALTS)).cast("int"))
    copied = known(dim).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col(_SALTS) - 1)))
    return dealt.drop(_SALTS), copied.drop(_SALTS)
