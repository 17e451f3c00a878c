"""Change detection and idempotent writes of a chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELETE_GUARD = 0.8
BUCKETS = 64


def diff(state: DataFrame, current: DataFrame, version: Column) -> DataFrame:
    """(path, status) of files in either: added, modified (content or parser changed), deleted or unchanged.

    state has (path, hash, parser_version), current has (path, hash).
    """
    s = state.select("path", F.col("hash").alias("old_hash"), "parser_version", F.lit(True).alias("known"))
    c = current.select("path", "hash", F.lit(True).alias("here"))
    status = (
        F.when(F.col("known").isNull(), "added").when(F.col("here").isNull(), "deleted")
        .when(F.col("hash").eqNullSafe(F.col("old_hash")) & F.col("parser_version").eqNullSafe(version), "unchanged").otherwise("modified")
    )
    return c.join(s, "path", "full_outer").select("path", status.alias("status"))


def guarded(changes: DataFrame, most: float = DELETE_GUARD) -> DataFrame:
    """changes without the deleted ones if they are more than a share of all known files, as an unmounted folder shows."""
    known = F.col("status") != "added"
    share = changes.agg((F.count_if(F.col("status") == "deleted") / F.greatest(F.count_if(known), F.lit(1))).alias("share"))
    return changes.crossJoin(F.broadcast(share)).where((F.col("status") != "deleted") | (F.col("share") <= most)).drop("share")


def clean_state(raw: DataFrame, root: str) -> DataFrame:
    """State rows with a path relative to the root and forward slashes; rows without chunks or with a negative number go."""
    forward = F.replace(F.coalesce("rel_path", "path"), F.lit("\\"), F.lit("/"))
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    path = F.when(forward.startswith(prefix), F.substring(forward, len(prefix) + 1, 1 << 30)).otherwise(forward)
    return raw.where("chunks >= 0 and hash is not null").select(path.alias("path"), "hash", "chunks", "parser_version").where("path is not null")


def delete_sources(table: DataFrame, sources: DataFrame) -> DataFrame:
    return table.join(sources.select("source").distinct(), "source", "left_anti")


def replace_sources(table: DataFrame, new: DataFrame) -> DataFrame:
    """table with all rows of the sources in `new` replaced; the same however often it is done."""
    return delete_sources(table, new).unionByName(new, allowMissingColumns=True)


def merge_payload(table: DataFrame, patch: DataFrame, columns: list[str], key: str = "source", sync: bool = False) -> DataFrame:
    """table with patch's columns by key: a null there keeps the old value, or, with sync, clears it."""
    news = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_patched"))
    joined = table.join(news, key, "left")
    value = lambda c: F.when(F.col("_patched"), F.col(f"_new_{c}")).otherwise(F.col(c)) if sync else F.coalesce(f"_new_{c}", c)
    return joined.select(*[(value(c) if c in columns else F.col(c)).alias(c) for c in table.columns])


class ChunkTable:
    """A Parquet table in buckets of sources, of which a write replaces only those that it touches.

    A write reads the touched buckets, puts their new content beside them and then swaps it in by dynamic partition
    overwrite, so a path that is read is never overwritten.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("source"), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        rows.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket", "source").write.partitionBy("bucket").mode("overwrite").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        """Whether any bucket has been written."""
        path, fs = self._files()
        return bool(fs.globStatus(path(f"{self.path}/bucket=*")))

    def upsert(self, new: DataFrame, deleted: DataFrame | None = None) -> None:
        """Replace the sources of `new` and drop those of `deleted`; without a table, make it of `new`.

        The new rows are put beside the table first, so what made them (parsing, embedding) runs once.
        """
        if not self.exists():
            return self.create(new)
        arrived = f"{self.path}.arrived"
        new.write.mode("overwrite").parquet(arrived)
        new = self.spark.read.schema(new.schema).parquet(arrived)
        try:
            self._replace(new, deleted)
        finally:
            path, fs = self._files()
            fs.delete(path(arrived), True)

    def _replace(self, new: DataFrame, deleted: DataFrame | None) -> None:
        sources = new.select("source") if deleted is None else new.select("source").union(deleted.select("source"))
        touched = [r.b for r in sources.select(self.bucket().alias("b")).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched)).drop("bucket")
        kept = replace_sources(delete_sources(old, deleted) if deleted is not None else old, new).select(old.columns)
        staged = f"{self.path}.staged"
        kept.withColumn("bucket", self.bucket()).write.mode("overwrite").parquet(staged)
        again = self.spark.read.parquet(staged)
        again.repartition("bucket").sortWithinPartitions("bucket", "source").write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(self.path)
        emptied = set(touched) - {r.bucket for r in again.select("bucket").distinct().collect()}
        fs_path, fs = self._files()
        for b in emptied:
            fs.delete(fs_path(f"{self.path}/bucket={b}"), True)
        fs.delete(fs_path(staged), True)
