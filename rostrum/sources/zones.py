"""Tables with a zone index: for each file and meeting, the least and the greatest id.

Rows are laid out by meeting and id, so a page of one meeting lies in one file or two. Its
reader looks into the index first, itself a table sorted by meeting, and opens only
files that may hold a row of the page. Rows come in writes, each with its own files and
zones; a write is seen once its zones are there, and one made again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rostrum.limits import HISTORY_PAGE

ROWS_PER_FILE = 1_000_000


def write_zoned(rows: DataFrame, path: str, job: str, ident: str, write: str,
                rows_per_file: int = ROWS_PER_FILE) -> None:
    """Lay out ``rows`` and index them under the name ``write``.

    Rows without meeting or id belong to no page and are left out. A meeting of any size is
    cut over files by its ids. The index has a row per file and meeting in it.
    """
    spark, data = rows.sparkSession, f"{path}/data/write={write}"
    laid_out = rows.where(F.col(job).isNotNull() & F.col(ident).isNotNull())
    (
        laid_out.repartitionByRange(job, ident).sortWithinPartitions(job, ident)
        .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(data)
    )
    stored = spark.read.schema(rows.schema).parquet(data)
    found = (
        stored.select("_metadata.file_name", job, ident).groupBy("file_name", job)
        .agg(F.min(ident).alias("least"), F.max(ident).alias("greatest"), F.count("*").alias("n"))
    )
    found.repartitionByRange(job).sortWithinPartitions(job, "least").write.mode("overwrite").parquet(
        f"{path}/zones/write={write}")


def page_files(spark: SparkSession, path: str, job: str, job_value, ident: str, schema: T.StructType,
               limit: int = HISTORY_PAGE, before=None) -> tuple[list[str], object]:
    """Files that may hold the newest ``limit`` rows before an id, and an id they aren't below.

    Zones that lie before the cursor as a whole are taken from the newest on until they hold
    enough rows, at most ``limit`` of them; no row older than the last of these is on the page.
    The driver gets these zones, and those that reach into what they span: one or two more
    in a table written once, more where several writes overlap there.
    """
    kind = schema[ident].dataType
    mine = spark.read.schema(T.StructType([
        T.StructField("file_name", T.StringType()), schema[job], T.StructField("least", kind),
        T.StructField("greatest", kind), T.StructField("n", T.LongType()),
        T.StructField("write", T.StringType())])).parquet(f"{path}/zones").where(F.col(job) == job_value)
    if before is not None:
        mine = mine.where(F.col("least") < before)
    whole = mine if before is None else mine.where(F.col("greatest") < before)
    rows, floor = 0, None
    for zone in whole.orderBy(F.desc("least")).limit(limit).collect():
        rows += zone.n
        if rows >= limit:
            floor = zone.least
            break
    if floor is not None:
        mine = mine.where(F.col("greatest") >= floor)
    return sorted(f"{path}/data/write={z.write}/{z.file_name}" for z in mine.collect()), floor


def history_page(spark: SparkSession, path: str, schema: T.StructType, job: str, job_value, ident: str,
                 limit: int = HISTORY_PAGE, before=None) -> DataFrame:
    """``chats.history_page`` from a table with zones: ids say what is newer.

    Rows that share an id are told apart by a hash of all they hold. A meeting that isn't
    there has an empty page.
    """
    files, floor = page_files(spark, path, job, job_value, ident, schema, limit, before)
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files).where(F.col(job) == job_value)
    if before is not None:
        rows = rows.where(F.col(ident) < before)
    if floor is not None:
        rows = rows.where(F.col(ident) >= floor)
    tie = F.xxhash64(*[f"`{c}`" for c in schema.names])
    return rows.orderBy(F.desc(ident), tie).limit(limit).orderBy(ident, F.desc(tie))
