import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from granary.llm import packing, sentence_pieces, token_binary, tokens

TEXTS = ["", None, "Hello World", "don't  STOP\n\tnow", "ßÄÉ naïve café", "日本語 текст Σας İstanbul", "a_b __ c'd 'S 12,345.6 %%% &&& ***", "<|endoftext|> and <|startoftext|>", "é combining", "x" * 5000, "\x1c\x85​\xa0 odd", "\x00nul"]


def library():
    return Tokenizer.from_file(tokens.vocabulary())


def ids(text, end):
    return [*library().encode(text or "", add_special_tokens=False).ids, end]


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_encoder_is_the_library():
    e = tokens.WordEncoder(tokens.vocabulary())
    r = random.Random(1)
    chars = [chr(c) for c in range(0x2100) if tokens.PLAIN.fullmatch(chr(c))]
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(chars if r.random() < 0.5 else list("abcST'_ 12.,-&")) for _ in range(r.randint(1, 15))) for _ in range(3000)]
    for t in texts:
        assert e.encode(t) == e.whole(t), ascii(t)


def docs(spark, extra=()):
    rows = [(3 * i, t, "z", i) for i, t in enumerate(TEXTS)] + list(extra)
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)


def test_token_shards(spark, monkeypatch):
    df = docs(spark, [(3, "again", "z", 0), (None, "no id", "z", 0)])
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_binary.round_trip(df).collect()), key=lambda x: x[1])
    want = [ids(t, 1) for t in ["no id", *TEXTS]]
    assert [g[0] for g in got] == sorted([3, *[3 * i for i in range(len(TEXTS))]], key=lambda x: x)[:0] + [None, *sorted([3, *[3 * i for i in range(len(TEXTS))]])]
    assert [g[1] for g in got] == np.cumsum([0, *[g[2] for g in got[:-1]]]).tolist()
    unique = [g for g in got if g[0] != 3]
    assert [g[2:] for g in unique] == [(len(w), crc(w)) for i, w in enumerate(want) if i != 2]
    assert sorted(g[2:] for g in got if g[0] == 3) == sorted([(len(w), crc(w)) for w in (want[2], ids("again", 1))])


def test_shard_format():
    dictionary = token_binary.train([np.arange(i, i + 50, dtype="<u2").tobytes() for i in range(200)], 1024)
    writer = token_binary.zstandard.ZstdCompressor(dict_data=token_binary.zstandard.ZstdCompressionDict(dictionary))
    docs = [np.arange(n, dtype="<u4") for n in (1, 0, 500)]
    data = token_binary.shard_bytes([(i, len(d), zlib.crc32(d.tobytes()), writer.compress(token_binary.narrow(d.tobytes(), 2))) for i, d in enumerate(docs)], 2, dictionary)
    shard = token_binary.Shard(data, dictionary)
    assert [shard.ids(i) for i in (2, 0, 1)] == [docs[i].tobytes() for i in (2, 0, 1)]
    with pytest.raises(ValueError, match="dictionary"):
        token_binary.Shard(data, dictionary + b"x")


def test_packing(spark, monkeypatch):
    rows = docs(spark, [(None, "no id", "z", 0), (3, "again", "z", 0), (99, "many words here " * 4000, "z", 0)])
    out = packing.pack(rows).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in [(3 * i, t) for i, t in enumerate(TEXTS) if i != 1] + [(None, "no id"), (99, "many words here " * 4000)]:
        all_ids, at = ids(text, 2), 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(all_ids) and r.ids_crc32 == crc(all_ids[at : at + r.length])
            at += r.length
        assert at == len(all_ids)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # no padding
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_balance():
    r = random.Random(8)
    lengths = np.array([r.choice([1, 3, 100, 900, 4096, 5000, 12288]) for _ in range(300)])
    pieces = packing.balance(lengths)
    for i, n in enumerate(lengths):
        own = sorted((s, k) for item, s, k, _, _ in pieces if item == i)
        assert sum(k for _, k in own) == n and all(a + k == b for (a, k), (b, _) in zip(own, own[1:], strict=False))
    cost, room = {}, {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
        room[s] = room.get(s, 0) + n
    shared = [cost[s] for s in room if room[s] == 4096 and sum(1 for p in pieces if p[3] == s) > 1]
    assert max(shared) <= 2.5 * min(shared)
    assert sum(room.values()) == lengths.sum()


# SentencePiece


def test_sampling_is_lossless_and_reproducible(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(70, "▁ literal ▁▁"), (71, "  two  spaces "), (72, "😀" * 9), (73, "word, word. (word) don't x-y_z\nnext\tline"), (None, "no id"), (2, "Hello World")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = sentence_pieces.encode(df.repartition(4))
    back = {(r.doc_id, r.text) for r in sentence_pieces.decode(encoded).collect()}
    assert back == {(d, t or "") for d, t in rows}
    again = sentence_pieces.encode(df.coalesce(1))
    assert sorted(map(tuple, encoded.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    other = sentence_pieces.encode(df, seed=6)
    assert sorted(map(tuple, other.collect()), key=repr) != sorted(map(tuple, again.collect()), key=repr)
    digest = {(r.doc_id, r.n_bytes, r.text_crc32) for r in sentence_pieces.round_trip(df).collect()}
    assert digest == {(d, len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in rows}
    assert sentence_pieces.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sampling_follows_the_lattice():
    p = sentence_pieces.Pieces(sentence_pieces.vocabulary())
    text = " there"
    weight = {b.decode(): p.weight[i] for i, b in enumerate(p.bytes) if len(b) > 1 or (b and b < b"\x80" and p.weight[i])}
    ways = {}

    def walk(at, path, w):
        if at == len(text):
            ways[path] = np.exp(w)
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in weight:
                walk(end, (*path, text[at:end]), w + weight[text[at:end]])

    walk(0, (), 0.0)
    total, n = sum(ways.values()), 20000
    drawn = {}
    for ids in sentence_pieces.Sampler(p).sample(list(range(n)), [text[1:]] * n):
        key = tuple(p.bytes[i].decode() for i in ids.tolist())
        drawn[key] = drawn.get(key, 0) + 1
    assert set(drawn) <= set(ways)
    for path, w in sorted(ways.items(), key=lambda x: -x[1])[:8]:
        share = w / total
        assert abs(drawn.get(path, 0) / n - share) < 4 * np.sqrt(share * (1 - share) / n) + 1e-4
    sharp = sentence_pieces.Sampler(sentence_pieces.Pieces(sentence_pieces.vocabulary(), theta=50.0))
    assert {tuple(x.tolist()) for x in sharp.sample(list(range(50)), ["there"] * 50)} == {tuple([next(i for i, b in enumerate(p.bytes) if b == b" there")])}


def test_token_files_outlive_the_session(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(60)] + [(None, "no id"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = f"{tmp_path}/tokens"
    token_binary.write(df, folder, buckets=5)
    other = token_binary.read(spark.newSession(), f"file://{folder}")
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in other.collect()), key=lambda x: x[0])
    encode = tokens.encoder(tokens.vocabulary()).encode
    want = [(-1 if d is None else d, len(ids) // 4, zlib.crc32(ids)) for d, t in rows for ids in [encode(t or "") + (1).to_bytes(4, "little")]]
    assert sorted((-1 if d is None else d, n, c) for _, d, n, c in got) == sorted(want)
    assert [d for _, d, _, _ in got][0] is None and [s for s, *_ in got] == [sum(n for *_, n, _ in got[:k]) for k in range(len(got))]
    script = f"from granary.llm import token_binary as t; import os; n = sorted(os.listdir({folder + '/shards'!r}))[0]; print(t.document({folder!r}, 'shards/' + n, 0).tolist())"
    first = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout
    assert first.strip() == str(np.frombuffer(encode("no id") + (1).to_bytes(4, "little"), "<u4").tolist())
