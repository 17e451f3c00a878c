"""Packing documents into fixed-length sequences of balanced attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import tokens

LENGTH = 4096
END = 2
#: Cost of n tokens in a sequence: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens and documents that a task packs together at most; a few tens of MB.
GROUP_TOKENS, GROUP_DOCS = 4_000_000, 8192

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def capacities(total: int, length: int = LENGTH) -> list[int]:
    """Room of the sequences that hold total tokens without padding: full ones, then a falling run of powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def balance(lengths: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of the items, every sequence exactly full.

    Whole sequences are cut off items longer than one. The rests go, longest first, each to the sequence of lowest cost
    among those with room for it; a piece that fits nowhere is cut to the room of the one with most room, and what
    remains goes on. Ties go to the earlier item and the earlier sequence.
    """
    pieces, sequence = [], 0
    full = lengths // length
    for item in np.flatnonzero(full):
        for j in range(int(full[item])):
            pieces.append((int(item), j * length, length, sequence, 0))
            sequence += 1
    rest = lengths % length
    room = np.array(capacities(int(rest.sum()), length), np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), np.int64)
    for item in np.argsort(-rest, kind="stable"):
        start, left = int(full[item]) * length, int(rest[item])
        while left:
            fits = np.flatnonzero(room >= left)
            to = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            n = min(left, int(room[to]))
            pieces.append((int(item), start, n, sequence + to, int(used[to])))
            room[to] -= n
            used[to] += n
            cost[to] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return pieces


def _packed(ids: list[int | None], data: list[bytes], base: int) -> pa.RecordBatch:
    counts = np.array([len(d) // 4 for d in data], np.int64)
    pieces = balance(counts)
    item, start, n, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
    crc = [zlib.crc32(memoryview(data[i])[4 * a : 4 * (a + k)]) for i, a, k in zip(item.tolist(), start.tolist(), n.tolist(), strict=True)]
    total = np.zeros(int(sequence.max()) + 1)
    np.add.at(total, sequence, LINEAR * n + QUADRATIC * n * n)
    columns = [pa.array(ids, pa.int64()).take(pa.array(item)), start, n, crc, counts[item], base + sequence, offset, total[sequence]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])


def _pack(path: str, end: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        encode, last = tokens.encoder(path).encode, end.to_bytes(4, "little")
        ids: list[int | None] = []
        data: list[bytes] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), tokens.texts(batch.column(1)), strict=True):
                ids.append(doc)
                data.append(encode(text) + last)
                size += len(data[-1]) // 4
                if size >= GROUP_TOKENS or len(data) >= GROUP_DOCS:
                    yield (out := _packed(ids, data, base))
                    base = out.column("sequence_id").to_numpy().max() + 1
                    ids, data, size = [], [], 0
        if data:
            yield _packed(ids, data, base)

    return pack


def pack(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """One row for each piece of a document in a sequence of at most LENGTH tokens.

    A document's ids are those of its whole text (null: empty) and then `end`. Each task packs its own documents, in
    groups of bounded size, so nothing is shuffled and a lost executor's tasks are simply run again; sequence_id is
    unique over all tasks and depends on how the input is split. A group's last tokens go to sequences whose lengths are
    powers of two, so no sequence needs padding. cost is the estimated attention cost of the piece's sequence. Repeated
    rows are packed each; a null doc_id stays null. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_pack(path or tokens.vocabulary(), end), SCHEMA)
