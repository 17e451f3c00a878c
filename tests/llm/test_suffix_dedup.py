import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from granary.llm import suffix_dedup as S


def brute(rows, length=S.LENGTH):
    """(n_bytes, n_removed, n_spans, sha256) of each (doc_id, text), in the order of doc_id and then text."""
    seen, out = set(), {}
    for key in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        raw = (key[1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.setdefault(key[0], []).append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["the", "ölt", "and", "ab", "thing", "re", "x", "lorem"]
    text = lambda k: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(k))
    shared = [text(r.randint(15, 90)) for _ in range(8)]
    rows = [(0, ""), (1, None), (2, "a" * 1500), (3, "ab" * 400), (4, "a" * 99), (5, "a" * 100), (6, "a" * 101)]
    for i in range(7, n):
        t = text(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            at = r.randint(0, len(t))
            t = t[:at] + s[a : r.randint(a, len(s))] + t[at:]
        rows.append((i, t))
    for i in range(n, n + 40):
        t = r.choice(rows)[1] or ""
        k = r.randint(0, max(0, len(t) - 1))
        rows.append((i, r.choice([t, t[:k] + "Q" + t[k:], t[k:], t + t])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([Row(doc_id=d, text=t) for d, t in rows], "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df).collect()}
    assert found == {k: v[0] for k, v in brute(rows).items()}


def test_maximal_repeats_match_brute_force():
    r = random.Random(5)
    base = "".join(r.choice("abc") for _ in range(40))
    texts = [(base[r.randint(0, 5) : r.randint(25, 40)] + "".join(r.choice("abc") for _ in range(20))).encode() for _ in range(12)]
    least = 10
    where = {}
    for t, x in enumerate(texts):
        for i in range(len(x)):
            for j in range(i + least, len(x) + 1):
                where.setdefault(x[i:j], []).append((t, i))
    want = set()
    for s, at in where.items():
        if len(at) < 2:
            continue
        side = lambda step: {texts[t][i + step] if 0 <= i + step < len(texts[t]) else ("edge", t, i) for t, i in at}
        if len(side(-1)) > 1 and len(side(len(s))) > 1:
            want.add((s, tuple(sorted(at))))
    assert {(s, tuple(at)) for s, at in S.maximal_repeats(texts, least)} == want


def test_blocks_and_chunks_do_not_matter(spark, monkeypatch):
    rows = corpus(9, 40)
    text = np.frombuffer(" ".join(t or "" for _, t in rows).encode(), np.uint8)
    valid = np.ones(len(text) - S.LENGTH + 1, bool)
    whole = S.anchors(text, valid)
    monkeypatch.setattr(S, "STRIDE", 1000)
    parts = S.anchors(text, valid)
    count = lambda x: [(int(p), int(a), int(h)) for lo, hi, a, h in zip(*x) for p in range(lo, hi + 1)]
    assert count(whole) == count(parts)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    long = "x y z " * 60
    rows = [(1, long, "p", 5), (1, long, "q", 6), (None, long, "r", 7), (2, long, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copy string, n_bytes int")
    out = S.remove_repeats(df, keep_text=True)
    assert out.columns[:4] == ["doc_id", "text", "copy", "n_bytes"]
    got = {(r.doc_id, r.copy): r for r in out.collect()}
    assert len(got) == 4
    assert got[(None, "r")].text == long and got[(None, "r")].n_removed == 0
    assert sorted(len(got[(1, c)].text) for c in "pq")[0] == 0
    assert got[(2, None)].text == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).collect() == []


@pytest.mark.parametrize("seed", [4, 5])
def test_hot_anchors(spark, monkeypatch, seed):
    """With every repeated anchor taken for hot, and with small arrays, the result is the same."""
    rows = corpus(seed)
    df = spark.createDataFrame([Row(doc_id=d, text=t) for d, t in rows], "doc_id long, text string").repartition(4)
    want = {k: v[0] for k, v in brute(rows).items()}
    for name, value in (("HOT", 3), ("ARRAY", 4)):
        tables = S.map_groups
        real = getattr(S, name)

        def patched(table, kernel, name=name, value=value):
            setattr(S, name, value)
            return kernel(table)

        monkeypatch.setattr(S, "map_groups", lambda df, keys, kernel, schema, tables=tables, patched=patched: tables(df, keys, lambda t: patched(t, kernel), schema))
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df).collect()}
        monkeypatch.setattr(S, "map_groups", tables)
        setattr(S, name, real)
        assert found == want


def test_matches_brute_force_on_a_table(spark):
    """All of sf0.001 with one line that opens every text, in surroundings of its own."""
    line = "This line of more than a hundred bytes opens each and every document of the corpus, whatever else it holds; "
    rows = [(x.doc_id, line + (x.text or "")) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df).collect()}
    assert found == {k: v[0] for k, v in brute(rows).items()}
