"""Raw browsing events.

Contract of a raw event: ``event_id`` unique, ``created_time`` in UTC without zone
and in whole seconds, ``host`` lower case without a leading ``www.``, ``url`` complete
with scheme. The ids may be strings or longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_COLUMNS = ("event_id", "user_id", "session_id", "created_time", "host", "url")

# Panel export columns, as delivered (fixed names).
EXPORT_SCHEMA = T.StructType([
    T.StructField("_ID", T.StringType()),
    T.StructField("USER_ID", T.StringType()),
    T.StructField("SESSION_ID", T.StringType()),
    T.StructField("CREATED_TIME", T.TimestampNTZType()),
    T.StructField("SUBDOMAIN", T.StringType()),
    T.StructField("URL", T.StringType()),
])


def raw_clicks(export: DataFrame) -> DataFrame:
    """Panel export -> raw events: names normalised, host in lower case."""
    return export.select(
        F.col("_ID").alias("event_id"),
        F.col("USER_ID").alias("user_id"),
        F.col("SESSION_ID").alias("session_id"),
        F.col("CREATED_TIME").cast("timestamp_ntz").alias("created_time"),
        F.lower("SUBDOMAIN").alias("host"),
        F.col("URL").alias("url"),
    )


def read_export(spark: SparkSession, path: str, schema: T.StructType | None = EXPORT_SCHEMA) -> DataFrame:
    """Parquet files of a panel export (directory or glob), read in place."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return raw_clicks(reader.parquet(path))
