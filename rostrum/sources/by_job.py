"""Tables laid out by meeting, so that one meeting is read from one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

JOB_BUCKETS = 256


def job_bucket(job: Column, buckets: int = JOB_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(job.cast("string")), F.lit(buckets)).cast("int")


def write_by_job(df: DataFrame, path: str, job: str, buckets: int = JOB_BUCKETS,
                 mode: str = "append") -> None:
    """Parquet partitioned by a bucket of the meeting key, sorted by meeting.

    Rebalancing gives each task an even share of the rows: the bucket of a large
    meeting is cut over many tasks and files, small buckets share a task. The
    order lets a read of one meeting skip the row groups of others.
    """
    (
        df.withColumn("job_bucket", job_bucket(F.col(job), buckets))
        .hint("rebalance", F.col("job_bucket"))
        .sortWithinPartitions("job_bucket", job)
        .write.mode(mode).partitionBy("job_bucket").parquet(path)
    )


def read_by_job(spark: SparkSession, path: str, job: str, job_value=None,
                buckets: int = JOB_BUCKETS) -> DataFrame:
    """The whole table, or one meeting: its bucket folds to a constant and prunes."""
    rows = spark.read.parquet(path)
    if job_value is not None:
        bucket = job_bucket(F.lit(job_value), buckets)
        rows = rows.where((F.col("job_bucket") == bucket) & (F.col(job) == job_value))
    return rows.drop("job_bucket")
