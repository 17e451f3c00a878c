import random
import zlib

import numpy as np
import pytest

from granary.llm import toxicity as T


def made(seed=1, n=260):
    """Documents of invented words, some with a word of a list or a word that begins with a stem."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "lo", "ri", "te", "nu", "sha"]) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(1, 150))]
        toxic = int(r.random() < 0.35)
        for _ in range(toxic * r.randint(1, 4)):
            words.insert(r.randint(0, len(words)), r.choice(["zork", "grump", "vexq" + word(), "vexq" + word()]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_windows_cover_all_words_twice():
    for n in (0, 1, 31, 32, 33, 48, 100, 1000):
        spans = T.windows(n)
        seen = np.zeros(n, int)
        for a, b in spans:
            assert 0 < b - a <= T.SPAN
            seen[a:b] += 1
        assert n == 0 or seen.min() >= 1
        assert n <= T.SPAN or seen[T.STEP : n - T.STEP].min() >= 2


def test_gradients():
    rng = np.random.default_rng(3)
    words = ["alpha", "be", "gam", "idea", "x", "longerword", "zz", "q1"]
    net = T.Network.fresh({w: i + 1 for i, w in enumerate(words[:6])}, {c: i + 4 for i, c in enumerate("abcdefghijklmnop")}, rng)
    for k in net.p:
        net.p[k] = net.p[k].astype("f8") + (0.1 * rng.standard_normal(net.p[k].shape) if k in ("bx", "ba", "conv_b") else 0)
    at, lengths, weight = rng.integers(0, 8, (5, T.SPAN)), np.array([32, 3, 10, 1, 20]), rng.standard_normal(5)

    def loss(keep=None):
        x = net.inputs(*net.spelled(words), keep)
        gates = net.gates(x)
        return (net.forward(gates, at, lengths, keep) * weight).sum(), x, gates

    keep = {}
    _, x, gates = loss(keep)
    for name, grad in net.backward(keep, x, gates, weight).items():
        v = net.p[name]
        for _ in range(5):
            i = tuple(rng.integers(0, s) for s in v.shape)
            old = v[i]
            v[i] = old + 1e-3
            up = loss()[0]
            v[i] = old - 1e-3
            down = loss()[0]
            v[i] = old
            assert abs((up - down) / 2e-3 - grad[i]) <= 0.02 * max(0.05, abs(grad[i])), name


def test_held_out_accuracy(spark):
    rows = made()
    extra = [(1000, None), (1001, ""), (1002, "!!!"), (None, "zork zork"), (0, rows[0][1]), (1003, "ba " * 20000 + "zork"), (1004, "a" * 5000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(i, t, "y") for i, t in extra], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (7, 5)], "doc_id long, toxic int")
    out = T.toxicity(docs, labels).collect()
    assert len(out) == len(rows) + len(extra)
    by = {r.doc_id: r for r in out}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (i in held) for i, _, _ in rows)
    truth = {i: y for i, _, y in rows}
    right = sum(by[i].predicted == truth[i] for i in held)
    assert right >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert by[1000].score == by[1001].score == by[1002].score and by[1003].predicted == 1 and by[None].held_out is False


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in T.toxicity(docs, none).collect()} <= {0, 1}
    assert T.toxicity(docs.limit(0), none).collect() == []


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    from granary.llm import packing
    from tests.llm.test_near_duplicates import similar_groups
    from tests.llm.test_suffix_dedup import brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "suffix_dedup", "packing"] and P.ORACLE_SQL is None
    at = docs
    seen = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, at, sf).write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(at)
        if k < 3:
            assert at.columns == docs.columns and at.dtypes == docs.dtypes
    scores = {r.doc_id: r.predicted for r in T.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    first = {r.doc_id: r.text for r in seen[0].collect()}
    assert set(first) == {d for d, p in scores.items() if not p}
    groups = similar_groups(list(first.items()))
    second = {r.doc_id: r.text for r in seen[1].collect()}
    assert set(second) == set(groups.values())
    want = brute(list(second.items()))
    third = {r.doc_id: r for r in seen[2].collect()}
    assert all(r.n_chars == len(r.text) for r in third.values())
    assert {d: len(r.text.encode()) for d, r in third.items()}.keys() == want.keys()
    assert all(abs(len(r.text.encode()) - (want[d][0][0] - want[d][0][1])) <= 6 * want[d][0][2] for d, r in third.items())
    total = {}
    for r in seen[3].collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.length <= packing.LENGTH
    assert total.keys() == third.keys()


def test_pipeline_on_nulls_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline as P

    texts = ["plain words of a short text here", None, "", "x", "long " * 9000]
    rows = [(i, t) for i, t in [*enumerate(texts), *enumerate(texts), *((None, t) for t in texts), (7, texts[0])]]
    docs = spark.createDataFrame([(i, t, "en", "a.com", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for _, stage in P.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
    # One row of each id that begins a group, and all without an id; null, empty and blank texts are one group.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 1), (False, 3), (False, 4)] + [(True, 0)] * 5
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {0, 1, 3, 4, None}


def test_pipeline_on_empty_documents(spark, tmp_path):
    import corpus_pipeline as P

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("column", ["copy", "_own_0_x", "score", "bucket"])
def test_stages_keep_clashing_columns(spark, column):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "some words of a text", 5), (2, None, None)], f"doc_id long, text string, `{column}` int")
    for _, stage in P.STAGES[:3]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and sorted((r.doc_id, r[column]) for r in out.collect() if r.doc_id == 1) == [(1, 5)]
