"""S1 as a stream: analyte CSV files landing in a folder -> typed Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderwell.sources.schema import READINGS_SCHEMA, typed_from_text

_TEXT_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in READINGS_SCHEMA.fields])


def stream_readings(spark: SparkSession, folder: str, schema: T.StructType = READINGS_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming frame of typed readings with the batch reader's null-token
    and NaN rules, plus the source file and its split start (file order)."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    r = (spark.readStream.schema(text).option("header", True).option("quote", '"')
         .option("escape", '"'))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.csv(folder).select("*", F.col("_metadata.file_path").alias("_file"),
                               F.col("_metadata.file_block_start").alias("_block"))
    return typed_from_text(raw, schema, keep=("_file", "_block"))


def ingest(spark: SparkSession, folder: str, table_path: str, checkpoint: str,
           available_now: bool = True):
    """Append new files' rows to a Parquet table (exactly once per file).
    ``available_now`` processes what is there and stops (scheduled runs)."""
    q = (stream_readings(spark, folder).writeStream.format("parquet")
         .option("path", table_path).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()
