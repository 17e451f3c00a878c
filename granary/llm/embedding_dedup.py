"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import connected_components, hashed_sample, map_groups, materialize, star_edges

THRESHOLD = 0.93
#: Vectors in a block of a cosine product; a task holds two blocks.
BLOCK = 2048
#: Vectors that a cell has on average, while there are fewer than MAX_CELLS cells.
CELL = 16_384
MAX_CELLS = 1024
#: Share of the cells that a vector may go to on average.
SPREAD = 0.25
#: About how many vectors the centres are fitted on (the ones with the smallest hashes); all vectors are assigned.
SAMPLE = 8192


def usable(vector: str) -> Column:
    """Whether the vector is there, without null or non-finite components, and not zero."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centres of the unit rows x; an empty cell keeps its centre."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def fitted_centres(x: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """At most k centres, halved while a vector of the sample would on average go to over SPREAD of the cells.

    Vectors without structure end with two cells: more would be copied to without sparing any comparison.
    """
    while True:
        centres = spherical_kmeans(x, min(k, len(x)))
        if k <= 2 or cells_of(x, centres, threshold)[1].mean() <= SPREAD:
            return centres
        k = max(2, k // 2)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cells_of(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row, and a mask of the cells where a vector within the threshold can be at home.

    Such a vector is at most the threshold's angle away, so a row further than that from the plane between its own
    centre and another has none in the other cell.
    """
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    margin = dots[np.arange(len(x)), home][:, None] - dots
    reach = np.sqrt(max(0.0, 1 - threshold * threshold)) if threshold > 0 else np.inf
    return home, margin <= reach * gap[home] + 1e-9


def _assign(centres: np.ndarray | None, threshold: float):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.diff(batch.column("vec").offsets.to_numpy())
            home = np.full(batch.num_rows, -1, np.int32)
            cells: list[list[int]] = [[-1]] * batch.num_rows  # vectors of another length than the centres' share one cell
            if centres is not None and len(fit := np.flatnonzero(lengths == centres.shape[1])):
                x = unit_rows(matrix(batch.column("vec").take(pa.array(fit))))
                home[fit], near = cells_of(x, centres, threshold)
                for i, row in zip(fit.tolist(), near, strict=True):
                    cells[i] = np.flatnonzero(row).tolist()
            extra = [pa.array(lengths.astype(np.int32)), pa.array(home), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "dim", "home", "cells"])

    return assign


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        role, rep, n = (table.column(c).to_numpy() for c in ("role", "rep", "n"))
        x = matrix(table.column("vec"))
        query, base = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        unit = unit_rows(x)
        dots = unit[query] @ unit[base].T
        hit = dots >= threshold
        for i, j in zip(*np.nonzero(np.abs(dots - threshold) < 1e-12), strict=True):  # on the edge: as defined
            a, b = x[query[i]], x[base[j]]
            hit[i, j] = float(a @ b) / (np.sqrt(float(a @ a)) * np.sqrt(float(b @ b))) >= threshold
        hit &= rep[query][:, None] != rep[base][None, :]
        links = hit.astype(np.float64) @ n[base]
        i, j = np.nonzero(hit)
        names, where = np.unique(rep, return_inverse=True)
        root = star_edges(len(names), where[query[i]], where[base[j]])
        src, some = np.flatnonzero(root != np.arange(len(names))), np.flatnonzero(links)
        return pa.table(
            {
                "node": np.concatenate([rep[query[some]], names[src]]),
                "links": np.concatenate([links[some].astype(np.int64), np.zeros(len(src), np.int64)]),
                "other": np.concatenate([rep[query[some]], names[root[src]]]),
            }
        )

    return compare


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links are all pairs of one label with cosine >= threshold.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label or id, link with
    nothing: n_links 0, component_id their own id. Vectors of different length don't link. Equal vectors of a label are
    one class, compared once and counted with their number; repeated rows each get a row and count as others. kept is
    whether the id is its component's smallest, null for a null id. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    good = usable("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = materialize(rows.where(good).groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    total = classes.count()
    fitted = [r.vec for r in hashed_sample(classes.select("rep", "vec"), "rep", sample)]
    centres = None
    if fitted:
        sizes = [len(v) for v in fitted]
        dim = max(set(sizes), key=lambda d: (sizes.count(d), d))
        x = unit_rows(np.array([v for v in fitted if len(v) == dim]))
        centres = fitted_centres(x, min(MAX_CELLS, max(2, -(-total // cell))), threshold)
    placed = classes.mapInArrow(_assign(centres, threshold), "label long, vec array<double>, rep long, n long, dim int, home int, cells array<int>")
    placed = placed.withColumn("cell", F.explode("cells")).drop("cells").withColumn("h", F.xxhash64("rep"))
    keys = ["label", "dim", "cell"]
    counts = placed.groupBy(*keys).agg(
        F.ceil(F.count_if(F.col("home") == F.col("cell")) / block).cast("int").alias("k_home"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("k_all")
    )
    dealt = placed.join(materialize(counts.where("k_home > 0")), keys)
    sub = lambda k: F.pmod("h", F.col(k).cast("long")).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    queries = dealt.where("home = cell").select(*keys, sub("k_home").alias("a"), every("k_all").alias("b"), F.lit(0).alias("role"), "rep", "n", "vec")
    base = dealt.select(*keys, every("k_home").alias("a"), sub("k_all").alias("b"), F.lit(1).alias("role"), "rep", "n", "vec")
    found = materialize(map_groups(queries.unionByName(base), [*keys, "a", "b"], _compare(threshold), "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found, "node", "other")
    named = (
        classes.join(links.withColumnRenamed("node", "rep"), "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.where(good).join(named, ["label", "vec"], "left").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
