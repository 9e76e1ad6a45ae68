"""Tables of keyed rows in buckets, merged by copying only the buckets a delivery touches.

Rows lie in ``data/<write>/bucket=<n>``. A version is a small file ``versions/<n>`` that
names the write each bucket is read from; it is created last and never overwritten, so
readers see a whole version or the one before, and of two writers on one version the
second fails. Files of a version stay as they are; ``vacuum`` removes writes that no kept
version names, ``rebucket`` writes the table anew when its buckets have grown too large.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rostrum.sources.by_job import job_bucket
from rostrum.sources.sinks import drop_folder, folder_of

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made the version first; merge again."""


def _versions(spark: SparkSession, path: str) -> list[int]:
    target, files = folder_of(spark, f"{path}/versions")
    if not files.exists(target):
        return []
    names = [f.getPath().getName() for f in files.listStatus(target)]
    return sorted(int(n) for n in names if n.isdigit())


def read_version(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """``{"version", "buckets", "writes": {bucket: write}}``, the newest by default."""
    if version is None:
        numbers = _versions(spark, path)
        if not numbers:
            return None
        version = numbers[-1]
    target, files = folder_of(spark, f"{path}/versions/{version}")
    stream = files.open(target)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    about = json.loads(text)
    return about | {"writes": {int(b): w for b, w in about["writes"].items()}}


def _commit(spark: SparkSession, path: str, version: int, buckets: int, writes: dict[int, str]) -> None:
    target, files = folder_of(spark, f"{path}/versions/{version}")
    text = json.dumps({"version": version, "buckets": buckets, "writes": writes})
    if files.exists(target):
        raise Conflict(f"version {version} of {path} is there")
    # Written beside and renamed: a name that exists is never replaced, and none is half written.
    beside, _ = folder_of(spark, f"{path}/versions/.{version}-{uuid.uuid4().hex}")
    out = files.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if files.exists(target) or not files.rename(beside, target):
        files.delete(beside, False)
        raise Conflict(f"version {version} of {path} is there")


def _at(path: str, write: str, bucket: int) -> str:
    return f"{path}/data/{write}/bucket={bucket}"


def read_snapshot(spark: SparkSession, path: str, schema, version: int | None = None,
                  buckets: list[int] | None = None) -> DataFrame:
    """All rows of a version, or those of some buckets; later merges don't change them."""
    about = read_version(spark, path, version)
    writes = about["writes"] if about else {}
    paths = [_at(path, w, b) for b, w in sorted(writes.items()) if buckets is None or b in buckets]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def last_written(rows: DataFrame, key: str, order: list[str], told_by: list[str] | None = None) -> DataFrame:
    """One row per key, the greatest by ``order``; rows that tie there are told apart by a
    hash of all they hold, so a merge gives the same whenever it is run.

    The hash is taken before rows move, so columns that nothing asks for later stay behind;
    ``told_by`` names the columns it is made of, if not all."""
    last = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order], F.desc("_tie"))
    tie = F.xxhash64(*[f"`{c}`" for c in told_by or rows.columns])
    return rows.withColumn("_tie", tie).withColumn("_rank", F.row_number().over(last)).where(
        "_rank = 1").drop("_rank", "_tie")


def _write(rows: DataFrame, path: str, bucket: Column) -> str:
    write = uuid.uuid4().hex
    rows.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).write.partitionBy(
        "bucket").parquet(f"{path}/data/{write}")
    return write


def merge_rows(rows: DataFrame, path: str, key: str, order: list[str],
               buckets: int = BUCKETS) -> int:
    """Merge ``rows`` into the table, the last write per ``key`` staying; the new version.

    Only buckets that hold a key of ``rows`` are read and written; the other buckets'
    files stay. Merging the same rows again changes no row. Rows without key are left out.
    ``buckets`` counts for a table that isn't there yet. Raises ``Conflict``, with nothing
    changed, if another merge came first. The delivery is made once, and lies beside the
    table meanwhile.
    """
    spark = rows.sparkSession
    about = read_version(spark, path)
    number, buckets, writes = (about["version"], about["buckets"], dict(about["writes"])) if about \
        else (0, buckets, {})
    bucket = job_bucket(F.col(key), buckets)
    beside = f"{path}/incoming/{uuid.uuid4().hex}"
    try:
        rows.where(F.col(key).isNotNull()).write.parquet(beside)
        rows = spark.read.schema(rows.schema).parquet(beside)
        touched = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())  # `buckets` at most
        if not touched:
            return number
        known = read_snapshot(spark, path, rows.schema, number or None, touched)
        write = _write(last_written(known.unionByName(rows), key, order), path, bucket)
    finally:
        drop_folder(spark, beside)
    _commit(spark, path, number + 1, buckets, writes | dict.fromkeys(touched, write))
    return number + 1


def rebucket(spark: SparkSession, path: str, key: str, schema, buckets: int) -> int:
    """Write the newest version anew in ``buckets`` buckets; the new version."""
    about = read_version(spark, path)
    bucket = job_bucket(F.col(key), buckets)
    rows = read_snapshot(spark, path, schema, about["version"])
    held = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())
    write = _write(rows, path, bucket)
    _commit(spark, path, about["version"] + 1, buckets, dict.fromkeys(held, write))
    return about["version"] + 1


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the ``keep`` newest versions, and data that none of those names.

    Not beside a running merge, whose data no version names yet.
    """
    numbers = _versions(spark, path)
    kept = [read_version(spark, path, n) for n in numbers[-keep:]]
    needed = {(w, b) for about in kept for b, w in about["writes"].items()}
    for n in numbers[:-keep]:
        drop_folder(spark, f"{path}/versions/{n}")
    target, files = folder_of(spark, f"{path}/data")
    for write in [f.getPath().getName() for f in files.listStatus(target)]:
        inside = [f.getPath().getName() for f in files.listStatus(folder_of(spark, f"{path}/data/{write}")[0])]
        held = [int(n.split("=")[1]) for n in inside if n.startswith("bucket=")]
        if not any((write, b) in needed for b in held):
            drop_folder(spark, f"{path}/data/{write}")
            continue
        for b in held:
            if (write, b) not in needed:
                drop_folder(spark, _at(path, write, b))
