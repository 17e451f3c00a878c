"""What the corpus operators share: materialising, connected components, link kernels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one in the warehouse where that is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/granary_scratch").rstrip("/")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and reread it: lineage is cut, and a lost executor loses nothing of it.

    The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hashed_sample(df: DataFrame, key: str, n: int) -> list[Row]:
    """About n rows (all, if there are no more), the same ones for the same table: those whose key hashes low.

    Only they reach the driver, 2 * n at most where rows repeat a key; of those the first by all their columns.
    """
    total = df.count()
    if total > n:
        df = df.where(F.xxhash64(key) <= F.lit(int(n / total * 2**64) - 2**63)).orderBy(F.xxhash64(key), F.xxhash64(*df.columns)).limit(2 * n)
    return sorted(df.collect(), key=lambda r: (r[key] is not None, r[key]))


def star_edges(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n local nodes, the smallest local index that it reaches over the links left[i]-right[i].

    Emitting (node, root) instead of the links keeps what leaves a task linear in its rows.
    """
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            return root
        root = new


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change; each round is written to the shared
    folder, and only a count and a checksum reach the driver. Both steps are a minimum per node, which combines before
    the shuffle, and an equi-join, whose hot keys adaptive execution splits.
    """
    e = materialize(
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    signature = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    last = e.agg(signature.alias("s")).first().s
    while last.n:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(signature.alias("s")).first().s
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the consecutive rows that agree in the integer key columns; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.zeros(batch.num_rows, bool)
        for c in columns:
            cuts[1:] |= c[1:] != c[:-1]
        cuts[0] = True
        starts = np.flatnonzero(cuts).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], kernel: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """kernel applied to the rows of each key, streamed from a partition sorted by the keys (Spark's sort spills).

    Unlike a grouped map this costs nothing per group, so many small groups are cheap.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for table in runs(batches, keys):
            out = kernel(table)
            if out is not None and out.num_rows:
                held.append(out)
                rows += out.num_rows
            if rows > 20_000:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)
