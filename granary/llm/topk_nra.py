"""Exact top-k inner products by no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import map_groups, materialize

#: Candidates in a shard and queries in a block; a task holds one of each.
SHARD = 8192
QUERIES = 2048


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null where the vector is null or has a null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, F.transform(v, lambda x: F.floor(x * scale).cast("long")))


class Lists:
    """One list a dimension, sorted by component, over a shard's vectors; read from either end.

    Bounds are sums in double precision with slack for their rounding; scores are integer sums.
    """

    def __init__(self, x: np.ndarray):
        self.whole = x
        self.x = x.astype(np.float64)
        self.most = np.abs(self.x).max(axis=0)
        #: Rows asked, and sums of the shares of the lists that were read for them.
        self.asked, self.read_share = 0, 0.0
        n, d = x.shape
        order = np.argsort(self.x, axis=0, kind="stable")
        self.place = np.empty((n, d), np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.sorted = np.take_along_axis(self.x, order, axis=0)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower): what `depth` entries from either end of each list say of each row, for weights to multiply.

        For positive weights (read from the largest) and then negative ones (from the smallest): a row's upper bound is
        its read components and, for lists that it wasn't met in, the last one read; its lower bound takes the list's
        last one instead.
        """
        n = len(self.x)
        first, last = self.sorted[0], self.sorted[-1]
        above, below = self.sorted[n - depth], self.sorted[depth - 1]
        met_above, met_below = self.place >= n - depth, self.place < depth
        upper = np.concatenate([np.where(met_above, self.x, above), np.where(met_below, self.x, below)], axis=1)
        lower = np.concatenate([np.where(met_above, self.x, first), np.where(met_below, self.x, last)], axis=1)
        return upper, lower

    def top(self, q: np.ndarray, k: int, own: list[tuple[int, int]], rows: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, rows and scores of all that can be among its k best inner products, ties included.

        own[i] is the range of rows that query i leaves out. All lists are read to the same depth, for a block of
        queries together, and twice as deep each time. A query stops once few rows have an upper bound that reaches its
        k-th lower bound, so that no row outside can qualify; the scores of those few are then completed.
        """
        n = len(self.x)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        active = np.arange(len(q))
        depth, few = max(1, n // 8), max(4 * k, n // 8)
        while len(active):
            depth = min(n, depth)
            upper, lower = self.read(depth)
            going = []
            for at in range(0, len(active), rows):
                block = active[at : at + rows]
                weights = np.concatenate([np.maximum(q[block], 0), np.minimum(q[block], 0)], axis=1).astype(np.float64)
                high, low = weights @ upper.T, weights @ lower.T
                for j, i in enumerate(block):
                    high[j, own[i][0] : own[i][1]] = low[j, own[i][0] : own[i][1]] = -np.inf
                best = min(k, n)
                bar = np.partition(low, n - best, axis=1)[:, n - best]
                slack = np.abs(q[block].astype(np.float64)) @ self.most * (1e-15 * q.shape[1])
                fit = (high >= (bar - slack)[:, None]) & (high > -np.inf)
                counts = fit.sum(axis=1)
                for j, i in enumerate(block):
                    if counts[j] <= few or depth == n:
                        found = np.flatnonzero(fit[j])
                        out[i] = (found, self.whole[found] @ q[i])
                        self.asked, self.read_share = self.asked + 1, self.read_share + depth / n
                    else:
                        going.append(i)
            active, depth = np.array(going, np.int64), depth * 2
        return out


def _search(k: int):
    def search(table: pa.Table) -> pa.Table | None:
        role, ids = table.column("role").to_numpy(), table.column("vec_id").to_numpy()
        vec = table.column("q").combine_chunks()
        x = vec.flatten().to_numpy().reshape(len(vec), -1)
        base, asked = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
        if not len(base) or not len(asked):
            return None
        base = base[np.argsort(ids[base], kind="stable")]
        names = ids[base]
        own = list(zip(np.searchsorted(names, ids[asked], "left").tolist(), np.searchsorted(names, ids[asked], "right").tolist(), strict=True))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, (rows, scores) in zip(asked, Lists(x[base]).top(x[asked], k, own), strict=True):
            best = np.lexsort((names[rows], -scores))[:k]
            out.append((np.full(len(best), ids[i]), names[rows[best]], scores[best]))
        query, found, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": query, "vec_id": found, "score": score})

    return search


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding", shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, the k best others.

    Scores are integer inner products of floor(256 * x), exact as far as they fit a long; ties go to the smaller vec_id. Vectors that are null or hold a
    null or non-finite component, and rows without an id, take no part; vectors are compared with those of their own
    length; rows that repeat an id count once. Fewer candidates than k: all of them. Other columns are ignored.

    Candidates are dealt into shards and queries into blocks by hash, and every block meets every shard; each task
    returns k rows a query, and the best of those are the result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector).alias("q")).where("vec_id is not null and q is not null")
    rows = materialize(rows.groupBy("vec_id").agg(F.min("q").alias("q")).withColumn("dim", F.size("q")).withColumn("h", F.xxhash64("vec_id")))
    asks = F.col("vec_id") % every == 0
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"), F.ceil(F.count_if(asks) / queries).cast("int").alias("blocks")
    )
    dealt = rows.join(materialize(sizes), "dim").where("blocks > 0")
    sub = lambda n: F.pmod("h", F.col(n).cast("long")).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = dealt.where(asks).select("dim", sub("blocks").alias("block"), to_all("shards").alias("shard"), F.lit(0).alias("role"), "vec_id", "q")
    base = dealt.select("dim", to_all("blocks").alias("block"), sub("shards").alias("shard"), F.lit(1).alias("role"), "vec_id", "q")
    found = map_groups(asked.unionByName(base), ["dim", "block", "shard"], _search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
