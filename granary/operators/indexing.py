"""From a folder to a searchable table: scan, compare, chunk, embed, replace, remember."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.embedding import Embed, embedded, hashed
from granary.operators import incremental
from granary.sources import files

PARSER_VERSION = "2.3"


def index_folder(spark: SparkSession, folder: str, table: incremental.ChunkTable, state: DataFrame | None, make: Callable[[], Embed] = lambda: hashed, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new state, changes) after the table has the folder's files: added and modified ones anew, deleted ones gone.

    state has (path, hash, chunks, parser_version), None at first; everything treats all files as modified. A folder
    that lost most files is taken for unreachable, and nothing is deleted.
    """
    scanned = files.scan(spark, folder)
    known = state if state is not None else spark.createDataFrame([], "path string, hash string, chunks int, parser_version string")
    changes = incremental.guarded(incremental.diff(known, scanned.select("path", "hash"), F.lit(PARSER_VERSION)))
    if everything:
        changes = changes.withColumn("status", F.when(F.col("status") == "unchanged", "modified").otherwise(F.col("status")))
    work = scanned.join(changes.where("status in ('added', 'modified')"), "path", "left_semi")
    chunks = embedded(files.chunks(work), "text", make)
    gone = changes.where("status in ('deleted', 'modified')").select(F.col("path").alias("source"))
    rows = chunks.where("issue is null").drop("issue")
    table.upsert(rows, gone)
    stored = table.read() if table.exists() else spark.createDataFrame([], "source string")
    counted = stored.groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("chunks"))
    kept = known.join(changes.where("status = 'deleted'"), "path", "left_anti").select("path", "hash")
    here = scanned.select("path", "hash")
    now = here.unionByName(kept.join(here, "path", "left_anti")).join(counted, "path", "left")
    return now.select("path", "hash", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.lit(PARSER_VERSION).alias("parser_version")), changes


def index_file(spark: SparkSession, path: str, table: incremental.ChunkTable, state: DataFrame, make: Callable[[], Embed] = lambda: hashed) -> DataFrame:
    """(path, status) of one file, skipped where its content and the parser are the known ones, else replaced.

    A file of a format that can't be read is an error.
    """
    if not path.lower().endswith(files.readable()):
        raise ValueError(f"no reader for {path}; there are readers for {', '.join(files.readable())}")
    found = files.scan(spark, path)
    status = incremental.diff(state, found.select("path", "hash"), F.lit(PARSER_VERSION)).join(found.select("path"), "path", "left_semi")
    work = found.join(status.where("status <> 'unchanged'"), "path", "left_semi")
    if not work.isEmpty():
        table.upsert(embedded(files.chunks(work), "text", make).where("issue is null").drop("issue"), work.select(F.col("path").alias("source")))
    return status


def publish(report: DataFrame, table: incremental.ChunkTable, make: Callable[[], Embed] = lambda: hashed) -> DataFrame:
    """(path, accepted, chunks): a report's accepted documents (path, text, accepted) chunked, embedded and put in the table.

    Documents with an error are left as they are in the table; the same report again changes nothing.
    """
    accepted = report.where("accepted")
    chunks = embedded(files.chunking.markdown_chunks(accepted.select(F.col("path").alias("source"), "text")), "text", make)
    table.upsert(chunks.where("issue is null").drop("issue"), accepted.select(F.col("path").alias("source")))
    stored = table.read() if table.exists() else report.select(F.col("path").alias("source")).limit(0)
    counted = stored.groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("chunks"))
    return report.select("path", "accepted").join(counted, "path", "left").withColumn("chunks", F.when(F.col("accepted"), F.coalesce("chunks", F.lit(0))))
