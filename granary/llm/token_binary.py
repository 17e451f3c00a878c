"""Token ids in binary shard files: each document compressed by itself with one shared zstandard dictionary.

A folder holds `shards/`, the `dictionary` and `index/`, a Parquet table of the shards in order; it outlives the session.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import tokens
from granary.llm.common import delete_on_exit, hashed_sample, shared_dir, shuffle_width

END = 1
LEVEL = 3
#: The dictionary is trained on about this many documents (those with the smallest hashes of doc_id), each up to SAMPLE_IDS ids.
SAMPLE, SAMPLE_IDS = 1000, 4096
DICTIONARY = 64 * 1024
#: Bytes of compressed documents in a shard, about.
SHARD = 4 << 20

MAGIC = b"GTOK\x01"
#: Magic, bytes an id, dictionary's SHA-256, number of documents.
HEADER = struct.Struct("<5sB32sQ")
#: doc_id, whether it is null, number of ids, crc32 of the ids, place of the frame after the index, its length.
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8"), ("crc", "<u4"), ("at", "<u8"), ("size", "<u8")])


def narrow(ids: bytes, width: int) -> bytes:
    """Unsigned 32-bit ids as unsigned integers of `width` bytes."""
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary trained on serialized id arrays; raw content of the samples where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"\0" * 8


class Shard:
    """An open shard file, or its bytes: beyond its index a document is read with one seek and one small decompression."""

    def __init__(self, data: bytes | BinaryIO, dictionary: bytes):
        self.file = io.BytesIO(data) if isinstance(data, bytes) else data
        magic, self.width, digest, n = HEADER.unpack(self.file.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.index = np.frombuffer(self.file.read(n * ENTRY.itemsize), ENTRY, n)
        self.begin = HEADER.size + n * ENTRY.itemsize
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, i: int) -> bytes:
        """Ids of the i-th document as little-endian unsigned 32-bit integers."""
        e = self.index[i]
        self.file.seek(self.begin + int(e["at"]))
        raw = self.reader.decompress(self.file.read(int(e["size"])), max_output_size=int(e["n"]) * self.width)
        ids = np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes()
        if len(ids) != 4 * int(e["n"]) or zlib.crc32(ids) != int(e["crc"]):
            raise ValueError("a document's ids don't match the index")
        return ids


def located(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; what pyarrow knows: local or mounted folders, HDFS, S3, GCS."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """A file as a whole or not at all: a task that runs again, or twice, leaves the same file."""
    unfinished = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(unfinished) as out:
        out.write(data)
    system.move(unfinished, path)


def shard_bytes(rows: list[tuple[int | None, int, int, bytes]], width: int, dictionary: bytes) -> bytes:
    """A shard of (doc_id, number of ids, crc32, frame) rows."""
    index, at = np.zeros(len(rows), ENTRY), 0
    for i, (doc, n, crc, frame) in enumerate(rows):
        index[i] = (doc or 0, doc is None, n, crc, at, len(frame))
        at += len(frame)
    return HEADER.pack(MAGIC, width, hashlib.sha256(dictionary).digest(), len(rows)) + index.tobytes() + b"".join(r[3] for r in rows)


def _encode(path: str, end: int, width: int, dictionary: bytes, bounds: np.ndarray):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = tokens.encoder(path).encode, end.to_bytes(4, "little")
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        for batch in batches:
            n, crc, frames = [], [], []
            for text in tokens.texts(batch.column("text")):
                ids = ids_of(text) + last
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                frames.append(writer.compress(narrow(ids, width)))
            ids = batch.column("doc_id")
            bucket = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, ids.fill_null(0).to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), ids, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(frames, pa.binary())],
                ["bucket", "doc_id", "n", "crc", "frame"],
            )

    return encode


def _write(folder: str, width: int, dictionary: bytes):
    """Sorted frames to shard files; what the index says of each, so that no shard's bytes go through Spark."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit():
            nonlocal inside
            total = sum(r[1] for r in rows)
            name = f"shards/{bucket:06d}-{shard:06d}.gtok"
            put(system, posixpath.join(path, name), shard_bytes(rows, width, dictionary))
            columns = [[bucket], [shard], [len(rows)], [total], [inside], [name]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            inside += total
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "shard", "docs", "tokens", "inside", "name"])

        system, path = located(folder)
        rows, size, bucket, shard, inside = [], 0, None, 0, 0
        for batch in batches:
            for b, doc, n, crc, frame in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "crc", "frame")), strict=True):
                if rows and (b != bucket or size >= SHARD):
                    yield emit()
                    rows, size, shard = [], 0, shard + 1
                if b != bucket:
                    bucket, shard, inside = b, 0, 0
                rows.append((doc, n, crc, frame))
                size += len(frame)
        if rows:
            yield emit()

    return write


def _read(folder: str, dictionary: bytes):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = located(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with system.open_input_file(posixpath.join(path, name)) as file:
                    shard = Shard(file.read(), dictionary)
                    n = shard.index["n"].astype(np.int64)
                    crc = [zlib.crc32(shard.ids(i)) for i in range(len(shard))]
                docs = pa.array(shard.index["doc_id"], mask=shard.index["null"].astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return read


def dictionary_for(docs: DataFrame, path: str, width: int) -> bytes:
    """The shared dictionary, trained on the documented sample of docs."""
    rows = docs.select("doc_id", F.substring("text", 1, 8 * SAMPLE_IDS).alias("text")).where("doc_id is not null")
    encode = tokens.encoder(path).encode
    return train([narrow(encode(r.text)[: 4 * SAMPLE_IDS], width) for r in hashed_sample(rows, "doc_id", SAMPLE) if r.text])


INDEX = "bucket int, shard int, docs long, tokens long, inside long, name string"


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, buckets: int | None = None) -> None:
    """Shard files, their dictionary and index in a folder that all executors share, in ascending order of doc_id.

    Documents are encoded and compressed where they are read; only frames are shuffled, to buckets of consecutive
    doc_ids whose bounds come from quantiles of doc_id, and sorted there. Null texts count as empty; rows without a
    doc_id come first; rows that repeat a doc_id are ordered by their ids' checksum. The folder must be new or empty.
    """
    path = path or tokens.vocabulary()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    width = 2 if tokens.encoder(path).library.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
    dictionary = dictionary_for(rows, path, width)
    system, at = located(folder)
    system.create_dir(posixpath.join(at, "shards"))
    put(system, posixpath.join(at, "dictionary"), dictionary)
    buckets = buckets or 4 * shuffle_width(docs.sparkSession)
    cuts = rows.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets).alias("q")).first().q or []
    encode = _encode(path, end, width, dictionary, np.array(sorted(set(cuts)), np.int64))
    frames = rows.mapInArrow(encode, "bucket int, doc_id long, n long, crc long, frame binary")
    ordered = frames.repartition("bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "crc", "n")
    ordered.mapInArrow(_write(folder, width, dictionary), INDEX).write.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a folder.

    start counts the ids of all documents before it: a shard has what comes before it in its bucket, and the sums of
    the buckets, of which there are four for each shuffle partition, are added up and broadcast.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    totals = index.groupBy("bucket").agg(F.sum("tokens").alias("total"))
    before = totals.select("bucket", (F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).alias("before"))
    placed = index.join(F.broadcast(before), "bucket").select("name", (F.col("before") + F.col("inside")).alias("start"))
    # A row is a file of some megabytes, so rows are spread over the tasks.
    spread = placed.repartition(max(1, min(index.count(), 2 * shuffle_width(spark))))
    return spread.mapInArrow(_read(folder, dictionary_of(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def dictionary_of(folder: str) -> bytes:
    system, at = located(folder)
    with system.open_input_file(posixpath.join(at, "dictionary")) as file:
        return file.read()


def document(folder: str, name: str, i: int) -> np.ndarray:
    """Ids of the i-th document of a shard file, without reading the rest of it."""
    system, at = located(folder)
    with system.open_input_file(posixpath.join(at, name)) as file:
        return np.frombuffer(Shard(file, dictionary_of(folder)).ids(i), "<u4")


def round_trip(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """The documents' digests as read back from the files that they were written to, in the session's shared folder."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/granary-tokens-{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)
    write(docs, folder, path, end)
    return read(spark, folder)
