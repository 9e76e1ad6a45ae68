"""Sinks that a repeated micro-batch cannot fill twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """The rows of one micro-batch under its own folder, replaced on a re-run."""
    df.write.mode("overwrite").parquet(batch_path(path, batch_id))


def read_batches(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).drop("batch_id")


def append_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 **options: str) -> StreamingQuery:
    """Exactly-once file sink; another sink is another ``fmt`` with its options."""
    return (
        stream.writeStream.format(fmt).options(**options)
        .option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def each_batch(stream: DataFrame, step, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """``step(rows, batch_id)`` per micro-batch; the checkpoint acknowledges it afterwards."""
    return (
        stream.writeStream.foreachBatch(step).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def folder_of(spark: SparkSession, path: str):
    """A path and the file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, path: str) -> None:
    target, files = folder_of(spark, path)
    files.delete(target, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    target, files = folder_of(spark, path)
    return files.exists(target)


def keep_last_folders(spark: SparkSession, path: str, name: str, last: int, keep: int = 2) -> None:
    """Remove numbered folders ``name=<n>`` before the ``keep`` newest up to ``last``.

    Does nothing unless the folder of ``last`` is there, which is newer than what goes.
    """
    target, files = folder_of(spark, path)
    if not files.exists(target):
        return
    numbers = sorted(
        int(f.getPath().getName().split("=")[1]) for f in files.listStatus(target)
        if f.getPath().getName().startswith(f"{name}=")
    )
    if last in numbers:
        for n in [n for n in numbers if n <= last][:-keep]:
            drop_folder(spark, f"{path}/{name}={n}")
