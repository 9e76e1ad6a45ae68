"""Record shapes shared by readers, messages and streams."""

from pyspark.sql import types as T

METADATA = T.StructType([
    T.StructField("originalFileName", T.StringType()),
    T.StructField("mimetype", T.StringType()),
    T.StructField("formatNames", T.ArrayType(T.StringType())),
    T.StructField("size", T.LongType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("uploadTimestamp", T.StringType()),
])

JOB_MESSAGE = T.StructType([
    T.StructField("jobId", T.StringType()),
    T.StructField("fileId", T.StringType()),
    T.StructField("metadata", METADATA),
])

CLEAN_CHUNKS = T.ArrayType(T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("refined_text", T.StringType()),
]))

FRAME = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("event", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

POINTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("upload_timestamp", T.TimestampNTZType()),
    T.StructField("text", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("seq", T.IntegerType()),
])
