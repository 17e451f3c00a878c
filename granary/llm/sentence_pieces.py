"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the lattice of pieces, lossless."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exponent of a piece's weight: 0 draws all segmentations alike, more prefers few and frequent pieces.
THETA = 1.0
SEED = 5
#: Stretches that a worker remembers the lattice of; longer ones than LONG characters are not remembered.
REMEMBERED, LONG = 200_000, 256
#: Stretches whose lattices are built at once.
LEARN = 20_000
#: Characters that are segmented at once.
CHARS = 500_000

_GOLDEN, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed function of 64-bit integers (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Trie:
    """Pieces by their characters, for walking from all places of a text at once."""

    def __init__(self, pieces: list[tuple[str, int]]):
        nodes: dict[tuple[int, str], int] = {}
        found = {}
        for text, i in pieces:
            node = 0
            for c in text:
                node = nodes.setdefault((node, c), len(nodes) + 1)
            found[node] = i
        self.longest = max((len(t) for t, _ in pieces), default=0)
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        self.piece[list(found)] = list(found.values())
        bits = max(4, (4 * len(nodes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.next = np.zeros((1 << bits) + 64, np.uint64), np.zeros((1 << bits) + 64, np.int32)
        for (node, c), to in nodes.items():
            key = (node << 21 | ord(c)) + 1
            slot = ((key * int(_GOLDEN)) & (2**64 - 1)) >> int(self.shift)
            while self.keys[slot]:
                slot += 1
            self.keys[slot], self.next[slot] = key, to

    def follow(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node after each one's next character, or 0."""
        key = (node.astype(np.uint64) << np.uint64(21) | code) + np.uint64(1)
        slot = (key * _GOLDEN >> self.shift).astype(np.int64)
        out = np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        while len(todo):
            met = self.keys[slot[todo]]
            hit = met == key[todo]
            out[todo[hit]] = self.next[slot[todo[hit]]]
            todo = todo[~hit & (met != 0)]
            slot[todo] += 1
        return out

    def matches(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in the text; none goes beyond stop[start]."""
        start, node = np.arange(len(codes)), np.zeros(len(codes), np.int32)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in range(1, self.longest + 1):
            node = self.follow(node, codes[start + length - 1])
            on = node > 0
            start, node = start[on], node[on]
            piece = self.piece[node]
            some = piece >= 0
            out.append((start[some], np.full(int(some.sum()), length), piece[some]))
            on = start + length < stop[start]
            start, node = start[on], node[on]
            if not len(start):
                break
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Pieces:
    """A vocabulary's pieces as text in which a space is a space, with a log weight each.

    The model's pieces are in order of rank, and a piece's probability is taken to fall with its rank as 1 / (rank + 3).
    Characters that are no piece are spelled with the 256 byte pieces, all of the last rank.
    """

    def __init__(self, path: str, theta: float = THETA):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int64)
        self.weight = np.zeros(n)
        plain, rank = [], 0
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:-1], 16)])
                self.byte_ids[self.bytes[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append((-model.get_score(i), i, piece.replace("▁", " ")))
        total = np.log(sum(1 / (r + 3) for r in range(len(plain) + 1)))
        for rank, (_, i, text) in enumerate(sorted(plain)):
            if " " in text.lstrip(" "):
                raise ValueError("a piece crosses from a word to the next")
            self.bytes[i] = text.encode()
            self.weight[i] = -theta * (np.log(rank + 3) + total)
        self.trie = Trie([(text, i) for _, i, text in plain])
        # Marks that no piece has after a letter: before them a word ends for all pieces.
        after = {b for _, _, text in plain for a, b in zip(text, text[1:], strict=False) if a.isalpha()}
        marks = re.escape("".join(c for c in map(chr, range(127)) if c != " " and not c.isalnum() and c not in after))
        #: Finds stretches, whose lattices no piece leaves: spaces and a word before such a mark, or all up to a space.
        self.stretch = re.compile(rf" *[^\W\d_]+(?=[{marks} ]|\Z)| *[^ ]+| +" if marks else " *[^ ]+| +")
        self.byte_weight = -theta * (np.log(len(plain) + 3) + total)


class Sampler:
    """Draws segmentations of texts; a draw depends only on the key, the seed and the text."""

    def __init__(self, pieces: Pieces, seed: int = SEED):
        self.pieces, self.seed = pieces, seed
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        #: First state of each stretch and its length; a state is a place in a stretch, 0 its begin.
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: First edge of each state; an edge has a threshold, the place where it starts, and a piece or, below 0, a character.
        self.first = np.zeros(0, np.int64)
        self.bar, self.source, self.label = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def learn(self, stretches: list[str]) -> None:
        """Add the lattices of new stretches, with the forward weights turned into thresholds of the edges into each place."""
        p = self.pieces
        size = np.array([len(s) for s in stretches], np.int64)
        codes = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(stretches)), size)
        stop = np.cumsum(size)
        source, length, label = p.trie.matches(codes, stop[owner])
        label, weight = label.astype(np.int64), p.weight[label]
        lone = np.ones(len(codes), bool)
        lone[source[length == 1]] = False
        if len(lone := np.flatnonzero(lone)):
            code = codes[lone].astype(np.int64)
            count = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            source, length = np.append(source, lone), np.append(length, np.ones(len(lone), np.int64))
            label, weight = np.append(label, -1 - code), np.append(weight, count * p.byte_weight)
        # A stretch of n characters has n + 1 states; an edge's place is where it ends in the stretch.
        own = owner[source]
        state0 = stop - size + np.arange(len(stretches))
        to = source + own + length
        place = to - state0[own]
        order = np.lexsort((to << 8 | length, place))
        to, length, label, weight, place = (x[order] for x in (to, length, label, weight, place))
        forward = np.zeros(len(codes) + len(stretches))
        joint = np.empty(len(to))
        cuts = np.searchsorted(place, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            value = forward[to[a:b] - length[a:b]] + weight[a:b]
            head = np.flatnonzero(np.append(True, to[a + 1 : b] != to[a : b - 1]))
            each = np.diff(np.append(head, b - a))
            top = np.maximum.reduceat(value, head)
            forward[to[a:b][head]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, each)), head))
            joint[a:b] = value
        # A state's longest edge first: it is the likeliest as a rule, so most draws end there.
        order = np.argsort(to << 8 | 255 - length)
        to, length, label = to[order], length[order], label[order]
        total = np.cumsum(np.exp(joint[order] - forward[to]))
        source = place[order] - length
        first = np.searchsorted(to, np.arange(len(forward) + 1))
        share = total - np.append(0, total)[first[to]]
        bar = np.minimum(np.round(share * 2.0**24) * 2.0**8, 2.0**32 - 1).astype(np.uint32)
        last = first[1:][first[1:] > first[:-1]] - 1
        bar[last] = np.uint32(2**32 - 1)
        base_state, base_edge, base = len(self.first) - 1 if len(self.first) else 0, len(self.bar), len(self.size)
        self.begin, self.size = np.append(self.begin, state0 + base_state), np.append(self.size, size)
        self.first = np.append(self.first[:-1], first + base_edge)
        self.bar, self.source, self.label = np.append(self.bar, bar), np.append(self.source, source.astype(np.int32)), np.append(self.label, label.astype(np.int32))
        self.known.update(zip(stretches, range(base, base + len(stretches)), strict=True))

    def sample(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, from a space and the text, drawn in proportion to the product of their weights."""
        stretches = [self.pieces.stretch.findall(" " + t) for t in texts]
        found = set().union(*stretches)
        if len(self.known) > REMEMBERED or self.first.size > 40 * REMEMBERED:
            self.reset()
        new = sorted(found.difference(self.known))
        for i in range(0, len(new), LEARN):
            self.learn(new[i : i + LEARN])
        flat = np.fromiter((i for s in stretches for i in map(self.known.__getitem__, s)), np.int64)
        counts = np.array([len(s) for s in stretches], np.int64)
        sizes = self.size[flat]
        start = np.cumsum(sizes) - sizes  # in all texts together
        doc = np.repeat(np.arange(len(texts)), counts)
        text0 = np.array([0] + [len(t) + 1 for t in texts], np.int64).cumsum()
        key = mixed(np.array([k & (2**64 - 1) for k in keys], np.uint64) * _GOLDEN + np.uint64(self.seed))[doc]
        out = np.zeros(int(text0[-1]), np.int32)
        used = np.zeros(int(text0[-1]), bool)
        here, at = np.arange(len(flat)), sizes.copy()
        while len(here):
            state = self.begin[flat[here]] + at
            where = (start[here] - text0[doc[here]] + at).astype(np.uint64)
            draw = (mixed(key[here] + where * _GOLDEN) >> np.uint64(32)).astype(np.uint32)
            edge = self.first[state]
            wait = np.flatnonzero(draw >= self.bar[edge])
            while len(wait):
                wait = wait[draw[wait] != np.uint32(2**32 - 1)]
                edge[wait] += 1
                wait = wait[draw[wait] >= self.bar[edge[wait]]]
            at = self.source[edge].astype(np.int64)
            out[start[here] + at] = self.label[edge]
            used[start[here] + at] = True
            going = at > 0
            here, at = here[going], at[going]
        result = []
        for i in range(len(texts)):
            ids = out[text0[i] : text0[i + 1]][used[text0[i] : text0[i + 1]]]
            result.append(self._spelled(ids) if (ids < 0).any() else ids)
        for s in [s for s in new if len(s) > LONG]:
            self.known.pop(s)  # not met again, as a rule
        return result

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        parts, last = [], 0
        for i in np.flatnonzero(ids < 0).tolist():
            raw = chr(-1 - int(ids[i])).encode("utf-8", "surrogatepass")
            parts += [ids[last:i], self.pieces.byte_ids[list(raw)].astype(np.int32)]
            last = i + 1
        return np.concatenate([*parts, ids[last:]])


def decode_ids(table: list[bytes], ids: np.ndarray) -> str:
    """The text of which ids are a segmentation: the bytes of all pieces, without the space put before."""
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def pieces(path: str, theta: float) -> Pieces:
    return Pieces(path, theta)


def _encode(path: str, theta: float, seed: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(pieces(path, theta), seed)

        def out(keys, texts):
            data = [ids.astype("<u4").tobytes() for ids in sampler.sample([k or 0 for k in keys], texts)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "ids"])

        for batch in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                keys.append(key)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= CHARS:
                    yield out(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield out(keys, texts)

    return encode


def encode(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """(doc_id, ids) with the ids of a sampled segmentation of each whole text as little-endian unsigned 32-bit integers.

    A row's draw depends only on its doc_id (null: 0), the seed and its text; repeated rows get the same. Null and empty
    texts get the segmentation of the one space that is put before every text. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_encode(path or vocabulary(), theta, seed), "doc_id long, ids binary")


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or pieces(path, THETA).bytes
            texts = [decode_ids(table, np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return decode


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with text, exactly the one that was encoded (null: empty)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path or vocabulary()), "doc_id long, ids binary, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = ([x.as_py() for x in batch.column(c)] for c in ("ids", "text"))
        raw = [t.encode() for t in texts]
        columns = [[len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], [len(t) for t in raw], [zlib.crc32(t) for t in raw]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_pieces", "ids_crc32", "n_bytes", "text_crc32"])


def round_trip(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, n_bytes, text_crc32) of each row's sampled ids and of the text decoded from them.

    Encoding and decoding are chained within one Python worker, batch by batch.
    """
    path = path or vocabulary()
    steps = (_encode(path, theta, seed), _decode(path), _digest)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(chained, "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, text_crc32 long")
