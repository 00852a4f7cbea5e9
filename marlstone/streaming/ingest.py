"""A folder of sources as a stream: every micro-batch is ingested by the same rules as a table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.functions import text as fn
from marlstone.library import Library


def ingest_stream(spark: SparkSession, library: Library, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A batch that runs again changes nothing: its documents are found by their hashes and skipped."""
    kind = fn.file_kind(F.col("raw_source"))
    rows = spark.readStream.format("text").option("wholetext", True).load(folder).withColumn("raw_source", F.col("_metadata.file_path"))
    sources = rows.select("raw_source", kind["kind"].alias("source_format"), F.when(kind["error"].isNull(), F.col("value")).alias("content"), kind["error"].alias("error"))
    writer = sources.writeStream.foreachBatch(lambda batch, _: library.ingest_table(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
