"""SimHash near-duplicates: exact Hamming links by tiled exclusive-or, pruned by population counts.

Two rules share the tiles: `near_duplicates` links fingerprints of 64 bits that differ in few bits; `similar` links texts
by the Jaccard similarity of their word shingles, with wide fingerprints to find candidates and an exact check after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import connected_components, map_groups, materialize, star_edges

RADIUS = 2
TILE = 4096
#: A fingerprint is cut into this many equal parts; the distance of the parts' population counts bounds the Hamming distance from below.
PARTS = 4
SEED = 42

#: Texts are similar from this Jaccard similarity of their shingles of so many words.
WORDS, LEAST = 5, 0.8
#: 64-bit words of a wide fingerprint.
WIDE = 4
#: At a similarity of 0.8 a bit differs with a probability of at most 0.19 (0.16 for texts of 20 words or more), so of the
#: first 128 and of all 256 bits more than these differ with a probability of 2e-7 at most (4e-10 for those longer ones).
NEAR_HALF, NEAR = 48, 84
#: Wide fingerprints in a tile, and shingles of its texts.
WIDE_TILE, TILE_SHINGLES = 32768, 4 << 20


def fingerprint(text: bytes, words: int = 3, chunk: int = 65536) -> int:
    """The 64-bit SimHash of the text's word shingles.

    ASCII letters are lower-cased, words are split at ASCII white space. Fewer words than a shingle has: the whole
    sequence is the one shingle. No words: 0. A bit is set if more than half of all shingle hashes have it.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), chunk):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + chunk], stops[at : at + chunk], strict=True)), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in batch.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def neighbours(radius: int = RADIUS, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Every offset of part counts within the radius, one of each pair of opposite offsets, zero first."""
    near = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * parts]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a and b at most radius bits apart."""
    left, right = [], []
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius)
        left.append(i + at)
        right.append(j)
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def _compare(radius: int):
    def compare(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        rep, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        order = np.lexsort((rep, side))
        fp, rep, side = fp[order], rep[order], side[order]
        first = int(np.searchsorted(side, 1))
        alone = first == len(side)  # a tile against itself
        i, j = tile_links(fp[:first], fp if alone else fp[first:], radius)
        j = j if alone else j + first
        root = star_edges(len(rep), i, j)
        linked = np.flatnonzero(root != np.arange(len(rep)))
        return pa.table({"src": rep[linked], "dst": rep[root[linked]]})

    return compare


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, dst) edges that connect exactly the fingerprints linked directly or through others in the same tile pair.

    classes has (fp, rep), each fp once. Tiles hold fingerprints whose four 16-bit parts have the same population
    counts; a tile pair whose counts differ by more than the radius in sum is never compared. A tile of more than
    `tile` fingerprints is dealt into sub-tiles by hash, all pairs of which are compared, so no task holds more than
    about two of them.
    """
    width = 64 // PARTS
    mask = (1 << width) - 1
    # A cell is a long with a byte for each part's count, so offsets add up as integers; 8 keeps every byte positive.
    cell = sum((F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit(mask))).cast("long") + 8) * (1 << 8 * i) for i in range(PARTS))
    cells = classes.select("fp", "rep", cell.alias("cell"), F.xxhash64("fp").alias("h"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("k"))
    steps = [sum(x << 8 * i for i, x in enumerate(d)) for d in neighbours(radius)]
    return map_groups(tile_rows(cells, sizes, steps, ["fp", "rep"]), TILE_KEYS, _compare(radius), "src long, dst long")


TILE_KEYS = ["low", "d", "a", "b"]


def tile_rows(cells: DataFrame, sizes: DataFrame, steps: list[int], carried: list[str]) -> DataFrame:
    """The rows of cells (cell, h, carried) for every pair of tiles that has to be compared, keyed by TILE_KEYS.

    sizes has (cell, k): a cell is dealt into k tiles by h. A cell meets those that are a step further, zero being
    itself. The tile of `low` has side 0, the other one side 1; a tile that meets itself comes once, as side 0.
    """
    sizes = materialize(sizes)
    # Tile pairs: `low` is the tile that the offset starts from, `high` the one it leads to.
    pairs = materialize(
        sizes.select(F.col("cell").alias("low"), F.col("k").alias("k_low"), F.explode(F.array(*[F.lit(x).cast("long") for x in steps])).alias("d"))
        .withColumn("high", F.col("low") + F.col("d"))
        .join(sizes.select(F.col("cell").alias("high"), F.col("k").alias("k_high")), "high")
    )
    own = F.col("d") == 0
    sub = lambda k: F.pmod("h", F.col(k).cast("long")).cast("int")
    as_low = cells.withColumnRenamed("cell", "low").join(pairs, "low").select(
        "low", "d", sub("k_low").alias("a"),
        F.explode(F.sequence(F.when(own, sub("k_low")).otherwise(F.lit(0)), F.col("k_high") - 1)).alias("b"),
        F.lit(0).alias("side"), *carried,
    )
    as_high = cells.withColumnRenamed("cell", "high").join(pairs.where(~own | (F.col("k_high") > 1)), "high").where(~own | (sub("k_high") > 0)).select(
        "low", "d",
        F.explode(F.sequence(F.lit(0), F.when(own, sub("k_high")).otherwise(F.col("k_low")) - 1)).alias("a"),
        sub("k_high").alias("b"), F.lit(1).alias("side"), *carried,
    )
    return as_low.unionByName(as_high)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Null and empty texts have fingerprint zero and link like any other. Documents with equal fingerprints form one
    class with the smallest doc_id as its node; only classes are compared. Repeated rows each get a row. Rows without
    a doc_id keep null ids and link to nothing. Other columns of docs are ignored.
    """
    prints = materialize(fingerprints(docs))
    classes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    components = connected_components(links(classes, radius))
    named = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp", "left").select("doc_id", hexed, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


_factors = np.random.default_rng(SEED).integers(0, 1 << 64, WORDS + 2 * WIDE, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; words are as for `fingerprint`, fewer of them are one shingle."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    words = min(words, len(own))
    out = np.full(len(own) - words + 1, words, np.uint64)
    for j in range(words):
        out = (out ^ own[j : j + len(out)]) * _factors[j % WORDS]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def wide_fingerprint(found: np.ndarray, chunk: int = 255 * 256) -> np.ndarray:
    """WIDE 64-bit words: a bit is set if more than half of the shingles have it in their rehash."""
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(found), chunk):
        part = found[at : at + chunk, None]
        mixed = part * _factors[WORDS : WORDS + WIDE]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _factors[WORDS + WIDE :]
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1)
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found)).view(np.uint64)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, sizes, lows, prints = [], [], [], []
        for x in batch.column(1).cast(pa.large_binary()):
            found = shingles(x.as_buffer().to_pybytes()) if x.is_valid else np.zeros(0, np.uint64)
            hashes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            sizes.append(len(found))
            lows.append(found[0] if len(found) else 0)
            prints.append(wide_fingerprint(found).tobytes())
        h, m = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hashes, lows))
        yield pa.RecordBatch.from_arrays([batch.column(0), h, pa.array(sizes, pa.int64()), m, pa.array(prints, pa.binary())], ["doc_id", "set", "n", "m", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x.as_buffer().to_pybytes()) if x.is_valid else np.zeros(0, np.uint64) for x in batch.column(1).cast(pa.large_binary())]
        h = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), h, pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "set", "shingles"])


def _prints_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE)


def _candidates(least: float):
    """Of two tiles, or one, the rows that have a candidate: a fingerprint near enough and a fitting number of shingles.

    Rows are ordered by population count, and blocks whose counts differ beyond the radius are skipped.
    """

    def candidates(table: pa.Table, rows: int = 128, columns: int = 4096) -> pa.Table:
        fp, n, side = _prints_of(table), table.column("n").to_numpy(), table.column("side").to_numpy()
        count = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
        order = np.lexsort((count, side))
        fp, n, count = fp[order], n[order], count[order]
        first = int(np.searchsorted(side[order], 1))
        alone = first == len(fp)
        met = np.zeros(len(fp), bool)
        for at in range(0, first, rows):
            to = min(at + rows, first)
            begin = at if alone else first
            start = begin + int(np.searchsorted(count[begin:], count[at] - NEAR, "left"))
            stop = begin + int(np.searchsorted(count[begin:], count[to - 1] + NEAR, "right"))
            for b in range(start, stop, columns):
                block = slice(b, min(b + columns, stop))
                half = np.bitwise_count(fp[at:to, None, 0] ^ fp[None, block, 0]) + np.bitwise_count(fp[at:to, None, 1] ^ fp[None, block, 1])
                i, j = np.nonzero(half <= NEAR_HALF)
                i, j = i + at, j + b
                fit = (i < j) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]))
                i, j = i[fit], j[fit]
                near = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= NEAR
                met[i[near]] = met[j[near]] = True
        return table.take(np.sort(order[met]))

    return candidates


def _similar(least: float):
    """(src, dst) that connect exactly the texts of two tiles, or of one, that are linked directly or through others."""

    def similar(table: pa.Table, room: int = 1 << 21) -> pa.Table:
        table = table.take(np.lexsort((table.column("rep").to_numpy(), table.column("side").to_numpy())))
        fp, rep = _prints_of(table), table.column("rep").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        begin = np.cumsum(n) - n
        known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        del sets
        has = np.zeros(len(known), bool)
        first = int(np.searchsorted(table.column("side").to_numpy(), 1))
        alone = first == len(fp)
        label = np.arange(len(fp))
        for i in range(first):
            other = i + 1 if alone else first
            j = other + np.flatnonzero(np.bitwise_count(fp[i] ^ fp[other:]).sum(axis=1, dtype=np.int64) <= NEAR)
            # Texts that are connected already need no check.
            j = j[(label[j] != label[i]) & (np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]))]
            if not len(j):
                continue
            own = ids[begin[i] : begin[i] + n[i]]
            has[own] = True
            linked = []
            ends = np.cumsum(n[j])
            cuts = [0, *(np.flatnonzero(np.diff(ends // room)) + 1).tolist(), len(j)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = j[a:b]
                size = n[part]
                at = np.cumsum(size) - size
                common = np.add.reduceat(has[ids[np.repeat(begin[part] - at, size) + np.arange(int(size.sum()))]], at, dtype=np.int64)
                linked.append(part[common >= least * (n[i] + size - common) - 1e-9])
            has[own] = False
            linked = np.concatenate(linked)
            if len(linked):
                joined = np.zeros(len(fp), bool)
                joined[label[linked]] = joined[label[i]] = True
                label[joined[label]] = np.flatnonzero(joined)[0]
        apart = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"src": rep[apart], "dst": rep[label[apart]]})

    return similar


def similar_links(classes: DataFrame, texts: DataFrame, least: float = LEAST, tile: int = WIDE_TILE, most: int = TILE_SHINGLES) -> DataFrame:
    """(src, dst) edges that connect exactly the classes linked by a similarity of `least`, directly or through others.

    classes has (set, n, m, fp, rep), each set of shingles once; texts (doc_id, text). Cells hold sets of like size, so a
    cell meets itself and the next one only; cells are dealt into tiles by their least shingle, which near-duplicates
    mostly share, and a frequent one is spread over several tiles. All tile pairs of such cells compare their
    fingerprints; only the texts with a candidate in a tile pair are sent there and checked.
    """
    # Sets of fewer than four are similar from 0.8 only if equal.
    rows = classes.where(F.col("n") * (1 - least) >= least - 1e-9).withColumn("cell", F.floor(F.log("n") / log(1 / least)).cast("long"))
    spread = max(1, tile // 8)
    frequent = rows.groupBy("cell", "m").agg(F.ceil(F.count(F.lit(1)) / spread).alias("c")).where("c > 1")
    h = F.pmod(F.xxhash64("m"), F.lit(1 << 40)) + F.pmod(F.xxhash64("rep"), F.coalesce("c", F.lit(1).cast("long")))
    cells = rows.join(materialize(frequent), ["cell", "m"], "left").select("cell", h.alias("h"), "set", "n", "fp", "rep")
    share = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("n") / most)).cast("int")
    tiles = tile_rows(cells, cells.groupBy("cell").agg(share.alias("k")), [0, 1], ["set", "n", "fp", "rep"])
    schema = "low long, d long, a int, b int, side int, set long, n long, fp binary, rep long"
    met = materialize(map_groups(tiles, TILE_KEYS, _candidates(least), schema))
    asked = met.select(F.col("rep").alias("doc_id")).distinct()
    sets = texts.join(asked, "doc_id", "left_semi").mapInArrow(_sets, "rep long, set long, shingles binary")
    sets = sets.groupBy("rep", "set").agg(F.first("shingles").alias("shingles"))
    return map_groups(met.join(sets, ["rep", "set"]).select(*TILE_KEYS, "side", "fp", "rep", "shingles"), TILE_KEYS, _similar(least), "src long, dst long")


def similar(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, component_id) for every different doc_id of docs: texts linked by a Jaccard similarity of `least` on word shingles.

    Null texts and texts without words are alike; a text of fewer words than a shingle has is like its equals only. Rows that repeat
    a doc_id are one document, linked by any of its texts. Rows without a doc_id take no part. The similarity is exact;
    a link is missed only where fingerprints of similar texts differ beyond NEAR, see there.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = materialize(texts.mapInArrow(_wide, "doc_id long, set long, n long, m long, fp binary"))
    classes = materialize(prints.groupBy("set", "n").agg(F.min("doc_id").alias("rep"), F.first("m").alias("m"), F.first("fp").alias("fp")))
    own = prints.join(classes.select("set", "n", "rep"), ["set", "n"]).select("doc_id", "rep").distinct()
    edges = similar_links(classes, texts, least).union(own.where("doc_id != rep"))
    components = connected_components(edges)
    return own.select(F.col("doc_id").alias("node")).distinct().join(components, "node", "left").select(F.col("node").alias("doc_id"), F.coalesce("component", "node").alias("component_id"))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, all their columns as they are, but of texts linked by a similarity of `least` only the smallest doc_id.

    Of rows that repeat that doc_id the first by text stays. Rows without a doc_id all stay.
    """
    return smallest_of_each(docs, similar(docs, least).where("doc_id = component_id").select("doc_id"))


def smallest_of_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is kept, the first by text of each, and all without a doc_id."""
    out = docs.join(kept, "doc_id", "left_semi")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        out = out.withColumn("_number", number).where("_number = 1").drop("_number")
    return out.unionByName(docs.where("doc_id is null"))
