"""A ledger of natural keys: a message that was consumed before is refused at intake.

Keys lie in buckets. A bucket has a Bloom filter and an exact table of its keys. A key that
its filter doesn't know is new, and nothing else is read for it. Only keys the filter
may know are looked up in the exact table, and only in their own buckets. So a step reads
the filters of the buckets it touches and the keys of those with a possible repeat, and
what is stored never has to be cleared of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from rostrum.operators import intake
from rostrum.sources.by_job import job_bucket
from rostrum.sources.sinks import each_batch, folder_exists, keep_last_folders, write_batch

BUCKETS = 256
BITS = 1 << 20  # of a bucket's filter: 1 % of unknown keys pass at about 100,000 keys
HASHES = 7

_KEYS = T.StructType([
    T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
    T.StructField("bucket", T.IntegerType()), T.StructField("batch_id", T.LongType())])
_FILTERS = T.StructType([
    T.StructField("bits", T.BinaryType()), T.StructField("bucket", T.IntegerType()),
    T.StructField("batch_id", T.LongType())])


def _places(keys: pa.Table, bits: int) -> np.ndarray:
    """Bits of each key: a row a key, by two hashes."""
    one, two = (keys[c].to_numpy().astype(np.uint64) for c in ("h1", "h2"))
    step = np.arange(HASHES, dtype=np.uint64)
    return ((one[:, None] + step * (two[:, None] | np.uint64(1))) >> np.uint64(11)) % np.uint64(bits)


def _array(filters: pa.Table, bits: int) -> np.ndarray:
    """One filter of all rows: what any of them knows."""
    out = np.zeros(bits // 8, np.uint8)
    for row in filters["bits"].to_pylist():
        out |= np.frombuffer(row, np.uint8)
    return out


def _asked(bits: int):
    def run(keys: pa.Table, filters: pa.Table) -> pa.Table:
        at, known = _places(keys, bits), _array(filters, bits)
        maybe = ((known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
        return keys.append_column("maybe", pa.array(maybe))
    return run


def _added(bits: int):
    def run(keys: pa.Table, filters: pa.Table) -> pa.Table:
        known = _array(filters, bits)
        at = _places(keys, bits).ravel()
        np.bitwise_or.at(known, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return pa.table({"bucket": keys["bucket"][:1], "bits": pa.array([known.tobytes()], pa.binary())})
    return run


class Ledger:
    """Keys seen so far, below ``path``; ``key`` are the columns that make a key."""

    def __init__(self, path: str, key: list[str], buckets: int = BUCKETS, bits: int = BITS) -> None:
        self.path, self.key, self.buckets, self.bits = path, key, buckets, bits

    def _stored(self, spark, name: str, schema: T.StructType) -> DataFrame:
        if not folder_exists(spark, f"{self.path}/{name}"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def marked(self, rows: DataFrame) -> DataFrame:
        one = F.xxhash64(F.lit(1), *self.key)
        return rows.withColumns({"h1": one, "h2": F.xxhash64(F.lit(2), *self.key),
                                 "bucket": job_bucket(one, self.buckets)})

    def unseen(self, rows: DataFrame, batch_id: int, looked_up: list | None = None) -> DataFrame:
        """The rows of a micro-batch whose keys no earlier one had, one per key.

        Keys of this batch's own number don't count as seen: it may be run again. The result
        is held in memory; ``unpersist`` it after use.
        ``looked_up`` gets, if given, how many keys the filters let through.
        """
        spark = rows.sparkSession
        mine = self.marked(rows).dropDuplicates(["h1", "h2"])
        keys = mine.select("h1", "h2", "bucket").persist()  # for its buckets and its filters
        try:
            touched = [r[0] for r in keys.select("bucket").distinct().collect()]  # `buckets` at most
            filters = self._stored(spark, "filters", _FILTERS).where(
                F.col("bucket").isin(touched) & (F.col("batch_id") < batch_id))
            asked = keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(
                _asked(self.bits), "h1 long, h2 long, bucket int, maybe boolean")
            maybe = asked.where("maybe").select("h1", "h2", "bucket").persist()
            try:
                held = [r[0] for r in maybe.select("bucket").distinct().collect()]
                if looked_up is not None:
                    looked_up.append(maybe.count())
                known = self._stored(spark, "keys", _KEYS).where(
                    F.col("bucket").isin(held) & (F.col("batch_id") < batch_id)).select("h1", "h2")
                repeated = maybe.join(known, ["h1", "h2"], "left_semi").select("h1", "h2")
                fresh = mine.join(repeated, ["h1", "h2"], "left_anti").persist()
                fresh.count()  # while what it is made of is held
                return fresh
            finally:
                maybe.unpersist()
        finally:
            keys.unpersist()

    def enter(self, rows: DataFrame, batch_id: int) -> None:
        """Write the keys of ``rows``, as ``unseen`` gave them, under the batch's number."""
        spark = rows.sparkSession
        keys = rows.select("h1", "h2", "bucket")
        touched = [r[0] for r in keys.select("bucket").distinct().collect()]
        before = self._stored(spark, "filters", _FILTERS).where(
            F.col("bucket").isin(touched) & (F.col("batch_id") < batch_id))
        number = F.lit(batch_id).cast("long")
        keys.withColumn("batch_id", number).hint("rebalance", F.col("bucket")).write.option(
            "partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "batch_id").parquet(
            f"{self.path}/keys")
        keys.groupBy("bucket").cogroup(before.groupBy("bucket")).applyInArrow(
            _added(self.bits), "bucket int, bits binary").withColumn("batch_id", number).write.option(
            "partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "batch_id").parquet(
            f"{self.path}/filters")
        for b in touched:  # a filter holds what those before it held
            keep_last_folders(spark, f"{self.path}/filters/bucket={b}", "batch_id", batch_id)


def consume_once(messages: DataFrame, path: str, checkpoint: str, **ledger) -> StreamingQuery:
    """Like ``intake.consume_messages``, but a message is stored once, however late and in
    whatever micro-batch it is delivered again: ``accepted`` needs no ``accepted_once``.

    A micro-batch that is run again replaces what it wrote, keys included.
    """
    book = Ledger(f"{path}/ledger", ["job_id", "file_id"], **ledger)

    def step(batch: DataFrame, batch_id: int) -> None:
        decoded = intake.decode_messages(batch).persist()  # read for both tables
        try:
            usable = F.col("decoded") & intake.is_present(F.col("job_id"))
            fresh = book.unseen(decoded.where(usable).select("job_id", "file_id", "metadata"), batch_id)
            try:
                write_batch(fresh.select("job_id", "file_id", "metadata"), f"{path}/accepted", batch_id)
                book.enter(fresh, batch_id)
            finally:
                fresh.unpersist()
            write_batch(
                decoded.where(~usable).select("value", F.when(~F.col("decoded"), "undecodable").otherwise(
                    "no_session").alias("reject_reason")), f"{path}/dead", batch_id)
        finally:
            decoded.unpersist()

    return each_batch(messages, step, checkpoint)
