"""Incremental indexing as a stream of new files, once for what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.functions import text as T
from granary.operators.incremental import ChunkTable
from granary.sources import files


def index_new(spark: SparkSession, folder: str, table: ChunkTable, checkpoint: str) -> StreamingQuery:
    """Chunks every file that the checkpoint hasn't seen and replaces its source's rows; the same batch again changes nothing.

    Deletions don't show in a stream of files: compare states for those (operators.incremental.diff).
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    rows = stream.withColumn("suffix", T.extension(F.col("path"))).where(F.col("suffix").isin(".md", ".txt", ".docx"))
    rows = rows.select("path", "content", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.md5("content").alias("hash"), "suffix")

    def write(batch: DataFrame, _: int) -> None:
        table.upsert(files.chunks(batch, pdf=False))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by time window, for batches and for streams with late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
