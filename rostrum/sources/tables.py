"""Table and stream readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores when its files leave at least half of them idle.

    ``keys`` identify a row, so that no value of one of them gathers in a task.

    A small table may be one row group, which one task reads; work that costs
    much per row should not stay there. A larger table is returned as it is,
    so this never shuffles what the cluster is already busy with.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if 2 * df.rdd.getNumPartitions() <= cores else df


def read_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
               **options: str) -> DataFrame:
    """Batch intake; the schema is given, so no file is read to infer it."""
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def stream_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                 files_per_step: int | None = None, **options: str) -> DataFrame:
    """Streaming twin of ``read_files``; ``files_per_step`` bounds one step's intake."""
    reader = spark.readStream.schema(schema).options(**options).format(fmt)
    if files_per_step:
        reader = reader.option("maxFilesPerTrigger", files_per_step)
    return reader.load(path)
