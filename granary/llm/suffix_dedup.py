"""Exact substring dedup: maximal repeats of an enhanced suffix array, found apart for each content-chosen anchor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import map_groups, shuffle_width

#: A string of this many bytes that also starts earlier is removed.
LENGTH = 100
#: Every window of LENGTH bytes has one anchor, the string of this many bytes in it with the least hash.
GRAM = 32
WINDOW = LENGTH - GRAM + 1
#: Bytes of text that a task scans at once and within which it combines equal contexts.
CHUNK = 12 << 20
#: Windows whose anchors are found in one go.
STRIDE = 1 << 18
#: Contexts that are made distinct or sent out at once, about, and distinct ones in one suffix array.
SLICE, ARRAY = 1 << 16, 1 << 12
#: Anchors of one hash, beyond which their windows are sent out by their own hashes instead of meeting in one array.
HOT = 1 << 11
#: Bytes of text a bucket of anchors comes from, about: 26 bytes of anchors for each 35 of text.
BUCKET = 128 << 20
#: A context is the text of consecutive windows that share an anchor, never longer than this.
CONTEXT = LENGTH + WINDOW - 1

#: Anchor's hash, document (id and number among rows of that id), first window, anchor after it, windows after the first.
RECORD = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("copy", "<i4"), ("lo", "<i4"), ("anchor", "u1"), ("span", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("copy", "<i4"), ("lo", "<i4"), ("hi", "<i4")])
PAIR = np.dtype([("lo", "<i4"), ("hi", "<i4")])
#: A window by the two halves of a 128-bit hash of its LENGTH bytes.
WINDOWED = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("copy", "<i4"), ("lo", "<i4")])

_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def packed(rows: np.ndarray, more: bytes = b"") -> bytes:
    """Rows column by column, which compress well when sorted, and some bytes after them."""
    columns = b"".join(rows[n].tobytes() for n in rows.dtype.names)
    return zstandard.compress(len(rows).to_bytes(8, "little") + columns + more, 1)


def unpacked(data: bytes, dtype: np.dtype) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(data)
    rows, at = np.empty(int.from_bytes(raw[:8], "little"), dtype), 8
    for name in dtype.names:
        kind = dtype[name]
        rows[name] = np.frombuffer(raw, kind, len(rows), at)
        at += len(rows) * kind.itemsize
    return rows, raw[at:]


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one big-endian integer; beyond the end there are zeros."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(text)]
    return out


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position that has so many."""
    x = words_at(text)
    x ^= x >> np.uint64(29)
    n = len(text) - GRAM + 1
    h = sum(x[8 * i : 8 * i + n] * m for i, m in enumerate(_MULTIPLY))
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def anchors(text: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor's hash) of each run of valid windows that share an anchor."""
    out = []
    for at in range(0, len(valid), STRIDE):
        ok = np.flatnonzero(valid[at : at + STRIDE])
        if not len(ok):
            continue
        h = gram_hashes(text[at : at + STRIDE + LENGTH - 1])
        low = np.uint64((1 << 20) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: len(h) - WINDOW + 1], least[WINDOW - 64 :])
        anchor = (least[ok] & low).astype(np.int64)
        first = np.ones(len(ok), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(ok)) - 1
        out.append((ok[starts] + at, ok[stops] + at, anchor[starts] + at, h[anchor[starts]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def contexts(text: np.ndarray, lo: np.ndarray, span: np.ndarray) -> np.ndarray:
    """A row of CONTEXT bytes for each record, with zeros beyond its own."""
    width = np.arange(CONTEXT)
    size = (span.astype(np.int64) + LENGTH)[:, None]
    rows = text[np.minimum(lo.astype(np.int64)[:, None] + width, len(text) - 1)]
    rows[width >= size] = 0
    return rows


def classes_of(records: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A number for each record; equal for records of one hash, anchor place and context, rising with the hash."""
    key = np.empty((len(records), 10 + CONTEXT), np.uint8)
    key[:, :8] = records["hash"].astype(">u8").view(np.uint8).reshape(-1, 8)
    key[:, 8], key[:, 9], key[:, 10:] = records["anchor"], records["span"], rows
    return np.unique(key.view(f"V{key.shape[1]}").ravel(), return_inverse=True)[1]


def suffix_order(text: np.ndarray, starts: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the 256 bytes from them, and the common length of each with the one before, 255 at most.

    rest says for every place of text how many bytes from it belong together; an end sorts before any byte.
    """
    n = len(text)
    short = np.minimum(rest, 8)
    word = words_at(text) & ~np.where(short < 8, np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * short.astype(np.uint64)) % np.uint64(64), np.uint64(0))
    ranks = {8: np.unique(np.unique(word, return_inverse=True)[1].astype(np.int64) * 9 + short, return_inverse=True)[1].astype(np.int64)}
    for size in (16, 32, 64, 128, 256):
        half = ranks[size // 2]
        after = np.zeros(n, np.int64)
        after[: max(0, n - size // 2)] = half[size // 2 :] + 1
        after[rest <= size // 2] = 0
        if size < 256:
            ranks[size] = np.unique(half * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((after[starts], half[starts]))
    a, b = starts[order][:-1], starts[order][1:]
    cap = np.minimum(np.minimum(rest[a], rest[b]), 255)
    common = np.zeros(len(a), np.int64)
    for size in (128, 64, 32, 16, 8):
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += np.where((common + size <= cap) & (ranks[size][x] == ranks[size][y]), size, 0)
    x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
    differ = word[x] ^ word[y]
    for i in range(7, 0, -1):  # equal leading bytes of the last word
        common += (differ >> np.uint64(8 * i)) == 0
    return order, np.append(0, np.minimum(common, cap))


def repeats(order: np.ndarray, common: np.ndarray, left: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places in the order) of every maximal repeat of at least `least` bytes, all its occurrences together.

    A stack holds the open intervals of the common-prefix interval tree; an interval is given out when it closes, if its
    occurrences don't all have the same byte to their left. left: that byte, or 256 where there is none, which differs
    from any other.
    """
    deep = common >= least
    runs = np.flatnonzero(deep & ~np.append(False, deep[:-1]))
    if not len(runs):
        return
    ends = np.flatnonzero(deep & ~np.append(deep[1:], False))
    by = left[order]
    for first, last in zip((runs - 1).tolist(), ends.tolist(), strict=True):
        here = by[first : last + 1]
        if (here == here[0]).all() and here[0] < 256:
            continue  # neither this interval nor one in it is maximal
        stack: list[tuple[int, int]] = []
        for i in [*range(first + 1, last + 1), last + 1]:
            depth, begin = (int(common[i]) if i <= last else 0), i - 1
            while stack and stack[-1][0] > depth:
                length, begin = stack.pop()
                found = by[begin:i]
                if (found == 256).any() or (found != found[0]).any():
                    yield length, np.arange(begin, i)
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, begin))


def maximal_repeats(texts: list[bytes], least: int = LENGTH) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Maximal repeats of at least `least` bytes, at most 255, over a few texts: (string, its (text, place) occurrences)."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - begin[owner]
    starts = np.flatnonzero(sizes[owner] - place >= least)
    if not len(starts):
        return []
    order, common = suffix_order(flat, starts, sizes[owner] - place)
    left = np.where(place == 0, 256, np.append(0, flat[:-1]).astype(np.int64))[starts]
    out = []
    for length, where in repeats(order, common, left, least):
        at = starts[order[where]]
        out.append((flat[at[0] : at[0] + length].tobytes(), sorted(zip(owner[at].tolist(), place[at].tolist(), strict=True))))
    return out


def united(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans joined where they overlap or touch, in order."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > reach[:-1])
    return lo[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]


def later_copies(records: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest record of each class, by class, and of all others."""
    kind = classes_of(records, rows)
    order = np.lexsort((records["lo"], records["copy"], records["doc"], kind))
    first = np.append(True, kind[order][1:] != kind[order][:-1])
    return order[first], order[~first]


def sliced(hashes: np.ndarray, size: int = SLICE) -> Iterator[slice]:
    """Slices of about so many sorted hashes, none of which is in two slices."""
    at = 0
    while at < len(hashes):
        stop = min(at + size, len(hashes))
        stop = int(np.searchsorted(hashes, hashes[stop - 1], "right"))
        yield slice(at, stop)
        at = stop


def _spans(records: np.ndarray) -> np.ndarray:
    out = np.zeros(len(records), SPAN)
    out["doc"], out["copy"], out["lo"] = records["doc"], records["copy"], records["lo"]
    out["hi"] = records["lo"] + records["span"].astype(np.int32) + LENGTH
    return out


def repeated_spans(records: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Spans of all windows in the records that also start earlier, of which all occurrences are among the records."""
    keep, drop = later_copies(records, rows)
    out = [_spans(records[drop])]
    records, rows = records[keep], rows[keep]
    same = records["hash"][1:] == records["hash"][:-1]  # classes rise with the hash
    several = np.flatnonzero(np.append(same, False) | np.append(False, same))
    records, rows = records[several], rows[several]
    for part in sliced(records["hash"], ARRAY):
        out += _array_spans(records[part], rows[part])
    return np.concatenate(out)


def _array_spans(records: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Spans of the repeats that a suffix array of some distinct contexts shows, without each one's earliest occurrence."""
    size = records["span"].astype(np.int64) + LENGTH
    flat = rows[np.arange(CONTEXT)[None, :] < size[:, None]]
    begin = np.cumsum(size) - size
    windows = size - LENGTH + 1
    owner = np.repeat(np.arange(len(records)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begin[owner] + place
    order, common = suffix_order(flat, starts, np.repeat(begin + size, size) - np.arange(len(flat)))
    left = np.where(place == 0, 256, flat[np.maximum(starts - 1, 0)].astype(np.int64))
    # Earlier occurrences have smaller ranks.
    rank = np.empty(len(owner), np.int64)
    rank[np.lexsort((records["lo"][owner] + place, records["copy"][owner], records["doc"][owner]))] = np.arange(len(owner))
    found: list[np.ndarray] = []
    for length, where in repeats(order, common, left):
        at = order[where]
        at = np.delete(at, np.argmin(rank[at]))
        more = np.zeros(len(at), SPAN)
        more["doc"], more["copy"] = records["doc"][owner[at]], records["copy"][owner[at]]
        more["lo"] = records["lo"][owner[at]] + place[at]
        more["hi"] = more["lo"] + length
        found.append(more)
    return found


def windowed(text: np.ndarray, records: np.ndarray, doc: int, copy: int) -> np.ndarray:
    """Every window of the records by a 128-bit hash of its bytes, which no two different windows share in practice."""
    count = records["span"].astype(np.int64) + 1
    lo = np.repeat(records["lo"], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out = np.zeros(len(lo), WINDOWED)
    out["doc"], out["copy"], out["lo"] = doc, copy, lo
    raw, digest = memoryview(text), xxhash.xxh3_128_digest
    hashed = np.frombuffer(b"".join([digest(raw[i : i + LENGTH]) for i in lo.tolist()]), "<u8").reshape(-1, 2)
    out["h1"], out["h2"] = hashed[:, 0], hashed[:, 1]
    return out


def later_windows(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earliest window of each pair of hashes, spans of all others)."""
    found = found[np.lexsort((found["lo"], found["copy"], found["doc"], found["h2"], found["h1"]))]
    later = np.append(False, (found["h1"][1:] == found["h1"][:-1]) & (found["h2"][1:] == found["h2"][:-1])) if len(found) else np.zeros(0, bool)
    spans = np.zeros(int(later.sum()), SPAN)
    for name in ("doc", "copy", "lo"):
        spans[name] = found[name][later]
    spans["hi"] = spans["lo"] + LENGTH
    return found[~later], spans


def _by_document(spans: np.ndarray) -> pa.Table:
    """(doc_id, copy, kind 1, data) with the spans of each document joined."""
    spans = spans[np.lexsort((spans["lo"], spans["copy"], spans["doc"]))]
    cut = np.flatnonzero(np.append(True, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["copy"][1:] != spans["copy"][:-1]))) if len(spans) else np.zeros(0, np.int64)
    data = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(spans)], strict=False):
        lo, hi = united(spans["lo"][a:b], spans["hi"][a:b])
        pairs = np.empty(len(lo), PAIR)
        pairs["lo"], pairs["hi"] = lo, hi
        data.append(pairs.tobytes())
    return pa.table({"doc_id": spans["doc"][cut], "copy": spans["copy"][cut], "data": pa.array(data, pa.binary())})


def _scan(buckets: int):
    """Anchors of all windows by bucket of their hash; spans of contexts that are in the chunk already, kind 1, ride along."""

    def flush(texts: list[np.ndarray], docs: list[int], copies: list[int]) -> pa.RecordBatch | None:
        size = np.array([len(t) for t in texts], np.int64)
        text = np.concatenate(texts)
        if len(text) < LENGTH:
            return None
        begin = np.cumsum(size) - size
        valid = np.ones(len(text) - LENGTH + 1, bool)
        for stop in (begin + size)[:-1].tolist():
            valid[stop - LENGTH + 1 : stop] = False
        lo, hi, anchor, h = anchors(text, valid)
        owner = np.searchsorted(begin, lo, "right") - 1
        records = np.zeros(len(lo), RECORD)
        records["hash"], records["doc"], records["copy"] = h, np.array(docs, np.int64)[owner], np.array(copies, np.int32)[owner]
        records["lo"], records["anchor"], records["span"] = lo - begin[owner], anchor - lo, hi - lo
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = order[np.append(same, False) | np.append(False, same)]
        gone = []
        for part in sliced(h[twice]):
            at = twice[part]
            gone.append(at[later_copies(records[at], contexts(text, lo[at], (hi - lo)[at]))[1]])
        gone = np.concatenate(gone) if gone else np.zeros(0, np.int64)
        spans, records = _spans(records[gone]), np.delete(records, gone)
        out = []
        for kind, rows, key in ((0, records, records["hash"]), (1, spans, spans["doc"].view(np.uint64))):
            bucket = (key * _MIX >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = rows[order]
            out += [(b, kind, packed(rows[cut[b] : cut[b + 1]])) for b in range(buckets) if cut[b] < cut[b + 1]]
        if not out:
            return None
        b, k, d = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, docs, copies, size = [], [], [], 0
        for batch in batches:
            for doc, copy, text in zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                if text.is_valid and len(raw := text.as_buffer()) >= LENGTH:
                    texts.append(np.frombuffer(raw, np.uint8))
                    docs.append(doc)
                    copies.append(copy)
                    size += len(raw)
                    if size >= CHUNK:
                        if (out := flush(texts, docs, copies)) is not None:
                            yield out
                        texts, docs, copies, size = [], [], [], 0
        if texts and (out := flush(texts, docs, copies)) is not None:
            yield out

    return scan


def _gathered(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    data = table.filter(pa.compute.equal(table.column("kind"), kind)).column("data")
    return np.concatenate([np.zeros(0, dtype), *(unpacked(x.as_py(), dtype)[0] for x in data)])


def _repeated(table: pa.Table) -> pa.Table:
    """Of a bucket's anchors those whose hash occurs twice or more, by document, kind 2 where it is hot; spans as they come."""
    records = _gathered(table, 0, RECORD)
    records = records[np.argsort(records["hash"], kind="stable")]
    same = records["hash"][1:] == records["hash"][:-1]
    records = records[np.append(same, False) | np.append(False, same)] if len(records) > 1 else records[:0]
    _, inverse, count = np.unique(records["hash"], return_inverse=True, return_counts=True)
    hot = count[inverse] > HOT if len(records) else np.zeros(0, bool)
    parts = [_grouped(records[~hot]), _grouped(records[hot]), _by_document(_gathered(table, 1, SPAN))]
    kinds = pa.array(np.repeat(np.int32([0, 2, 1]), [len(p) for p in parts]))
    return pa.concat_tables(parts).append_column("kind", kinds)


def _grouped(records: np.ndarray) -> pa.Table:
    """(doc_id, copy, data) with the records of each document."""
    records = records[np.lexsort((records["lo"], records["copy"], records["doc"]))]
    cut = np.flatnonzero(np.append(True, (records["doc"][1:] != records["doc"][:-1]) | (records["copy"][1:] != records["copy"][:-1]))) if len(records) else np.zeros(0, np.int64)
    data = [records[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(records)], strict=False)]
    return pa.table({"doc_id": records["doc"][cut], "copy": records["copy"][cut], "data": pa.array(data, pa.binary())})


def _contexts(buckets: int):
    """The anchors' contexts by bucket of their hash, with the text that they are in; spans as they come.

    Of hot anchors the windows, kind 2, by their own hashes, of which only the earliest in a batch go on.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Records with their contexts one after another, windows of hot anchors, and spans.
        held: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        windows: list[np.ndarray] = []
        given: list[np.ndarray] = []
        waiting = 0

        def dealt(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bucket = (key * _MIX >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            return order, np.searchsorted(bucket[order], np.arange(buckets + 1))

        def flush() -> pa.RecordBatch:
            out: list[tuple[int, int, bytes]] = []
            if held:
                records, flat = np.concatenate(held), np.concatenate(texts)
                size = records["span"].astype(np.int64) + LENGTH
                begin = np.cumsum(size) - size
                order, cut = dealt(records["hash"])
                size, begin, records = size[order], begin[order], records[order]
                stop = np.append(0, np.cumsum(size))
                flat = flat[np.repeat(begin - stop[:-1], size) + np.arange(len(flat))]
                out += [(b, 0, packed(records[cut[b] : cut[b + 1]], flat[stop[cut[b]] : stop[cut[b + 1]]].tobytes())) for b in range(buckets) if cut[b] < cut[b + 1]]
            if windows:
                first, later = later_windows(np.concatenate(windows))
                given.append(later)
                order, cut = dealt(first["h1"])
                out += [(b, 2, packed(first[order[cut[b] : cut[b + 1]]])) for b in range(buckets) if cut[b] < cut[b + 1]]
            if given:
                spans = np.concatenate(given)
                order, cut = dealt(spans["doc"].view(np.uint64))
                out += [(b, 1, packed(spans[order[cut[b] : cut[b + 1]]])) for b in range(buckets) if cut[b] < cut[b + 1]]
            b, k, d = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])

        for batch in batches:
            for doc, copy, text, anchored, hot, spans in zip(
                batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text").cast(pa.large_binary()), batch.column("anchored"), batch.column("hot"), batch.column("spans"), strict=True
            ):
                anchored, hot, spans = anchored.as_py(), hot.as_py(), spans.as_py()
                raw = np.frombuffer(text.as_buffer(), np.uint8) if anchored or hot else None
                if hot:
                    windows.append(windowed(raw, np.frombuffer(b"".join(hot), RECORD), doc, copy))
                    waiting += len(windows[-1])
                if anchored:
                    held.append(np.frombuffer(b"".join(anchored), RECORD))
                    rows = contexts(raw, held[-1]["lo"], held[-1]["span"])
                    texts.append(rows[np.arange(CONTEXT)[None, :] < held[-1]["span"].astype(np.int64)[:, None] + LENGTH])
                    waiting += len(held[-1])
                if spans:
                    pairs = np.frombuffer(b"".join(spans), PAIR)
                    given.append(np.zeros(len(pairs), SPAN))
                    given[-1]["doc"], given[-1]["copy"], given[-1]["lo"], given[-1]["hi"] = doc, copy, pairs["lo"], pairs["hi"]
                    waiting += len(pairs)
                if waiting >= SLICE:
                    yield flush()
                    for x in (held, texts, windows, given):
                        x.clear()
                    waiting = 0
        if waiting:
            yield flush()

    return take


def _compared(table: pa.Table) -> pa.Table:
    """The spans that a bucket's contexts show to be repeated, and those that came along, by document."""
    parts = [unpacked(x.as_py(), RECORD) for x in table.filter(pa.compute.equal(table.column("kind"), 0)).column("data")]
    spans = [_gathered(table, 1, SPAN), later_windows(_gathered(table, 2, WINDOWED))[1]]
    if parts:
        records = np.concatenate([r for r, _ in parts])
        flat = np.frombuffer(b"".join(t for _, t in parts), np.uint8)
        del parts
        size = records["span"].astype(np.int64) + LENGTH
        begin = np.cumsum(size) - size
        order = np.argsort(records["hash"], kind="stable")
        begin, records = begin[order], records[order]
        for part in sliced(records["hash"]):
            spans.append(repeated_spans(records[part], contexts(flat, begin[part], records["span"][part])))
    return _by_document(np.concatenate(spans))


def _finish(columns: list[str], keep_text: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, hashes, kept_texts = [], [], [], [], []
            for text, spans in zip(batch.column("text").cast(pa.large_binary()), batch.column("spans").to_pylist(), strict=True):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                pairs = np.frombuffer(b"".join(spans or []), PAIR)
                lo, hi = united(pairs["lo"], pairs["hi"])
                cuts = [0, *np.column_stack([lo, hi]).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                sizes.append(len(raw))
                removed.append(int((hi.astype(np.int64) - lo).sum()))
                runs.append(len(lo))
                if keep_text:
                    kept_texts.append(kept.decode("utf-8", "ignore") if text.is_valid else None)
                else:
                    hashes.append(hashlib.sha256(kept).hexdigest())
            digest = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)] + [pa.array(kept_texts if keep_text else hashes, pa.string())]
            rest = [c for c in columns if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *digest], [*rest, "n_bytes", "n_removed", "n_spans", "text" if keep_text else "kept_sha256"])

    return finish


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and, in place of text, kept_sha256 of the kept bytes.

    With keep_text: the kept text, of which characters that are cut in two are dropped, in place of the hash.

    Every byte goes that a LENGTH-byte string covers which also starts earlier: in a row of smaller doc_id or earlier in
    the same text. Rows that repeat a doc_id are separate documents, ordered by their texts (nulls first). A null text
    counts as empty and stays null. Rows without a doc_id keep all and remove nothing elsewhere. A row's other columns
    stay, whatever their names.

    A window's anchor depends on its bytes alone, so equal windows meet under one anchor hash. Each task combines equal
    contexts of its own chunk first; anchors whose hash is not met again go, and only the contexts of the others are
    sent out and compared, in enhanced suffix arrays of bounded size. Anchors met more than HOT times, as those of a very
    common line are, don't meet in one array: their windows are sent out by 128-bit hashes of all their bytes, the
    earliest of each task only, so a common string costs a task no more than a row for each other task. That changes the
    plan, not the result. Buckets grow in number with the text, so what a task holds of them doesn't. The texts are shuffled once by
    document for both joins; anchors cost 26 bytes for each 35 of text, before compression.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(2 * shuffle_width(spark), size // BUCKET)
    columns = list(docs.columns)
    clash = {c: f"_own_{i}_{c}" for i, c in enumerate(columns) if c.lower() not in ("doc_id", "text")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in clash.items()])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    known = rows.where("doc_id is not null")
    copy = F.lit(0)
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        copy = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1
    known = known.withColumn("copy", copy.cast("int"))

    scanned = known.select("doc_id", "copy", "text").mapInArrow(_scan(buckets), "bucket int, kind int, data binary")
    twice = map_groups(scanned, ["bucket"], _repeated, "doc_id long, copy int, data binary, kind int")
    by_doc = twice.groupBy("doc_id", "copy").agg(
        *[F.collect_list(F.when(F.col("kind") == k, F.col("data"))).alias(name) for k, name in ((0, "anchored"), (2, "hot"), (1, "spans"))]
    )
    shown = known.join(by_doc, ["doc_id", "copy"]).mapInArrow(_contexts(buckets), "bucket int, kind int, data binary")
    spans = map_groups(shown, ["bucket"], _compared, "doc_id long, copy int, data binary")
    spans = spans.groupBy("doc_id", "copy").agg(F.collect_list("data").alias("spans"))
    digest = f"n_bytes long, n_removed long, n_spans long, {'text' if keep_text else 'kept_sha256'} string"
    kept = known.join(spans, ["doc_id", "copy"], "left").mapInArrow(_finish(rows.columns, keep_text), ", ".join([*fields, digest]))
    unknown = rows.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<binary>"))
    out = kept.unionByName(unknown.mapInArrow(_finish(rows.columns, keep_text), ", ".join([*fields, digest])))
    names = {"doc_id": F.col("doc_id"), "text": F.col("text") if keep_text else None} | {c: F.col(n).alias(c) for c, n in clash.items()}
    own = [c for key in columns if (c := names[key.lower()] if key.lower() in ("doc_id", "text") else names[key]) is not None]
    added = [c for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256") if c in out.columns and c not in columns]
    return out.select(*own, *added)
