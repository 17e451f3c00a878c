import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from granary.llm import embedding_dedup, registry, simhash, topk_nra
from granary.llm.common import connected_components, star_edges
from tests.compare import DATA, rows_of, sql_rows


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    df = registry.queries()[name](spark, DATA)
    names, want = sql_rows(registry.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_connected_components(spark):
    r = random.Random(2)
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(200, i) for i in range(201, 260)]
    pairs = path + star + [(r.randint(0, 90), r.randint(0, 90)) for _ in range(60)] + [(5, 5)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = components({n for p in pairs for n in p}, pairs)
    assert got == {n: c for n, c in want.items() if n in {x for a, b in pairs if a != b for x in (a, b)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_star_edges():
    r = random.Random(3)
    pairs = [(r.randrange(50), r.randrange(50)) for _ in range(30)]
    want = components(range(50), pairs)
    got = star_edges(50, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert dict(enumerate(got.tolist())) == want


# SimHash


def slow_fingerprint(text):
    words = [w for w in text.translate({i: i + 32 for i in range(65, 91)}).encode().split() if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def corpus(seed=1, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice("ab Cd éf gh ij".split()) + str(r.randint(0, 40)) for _ in range(r.randint(0, 80))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(n, 2 * n):
        t = r.choice(base).split()
        if t and r.random() < 0.7:
            t[r.randrange(len(t))] = "new"
        rows.append((i, " \t".join(t)))
    return [*rows, (500, None), (501, ""), (502, " \n "), (503, "one"), (504, "One"), (505, "one two"), (506, "x " * 30000)]


def test_fingerprints():
    for _, t in corpus():
        assert simhash.fingerprint((t or "").encode()) == slow_fingerprint(t or "")


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash_groups_match_brute_force(spark, monkeypatch, tile):
    rows = corpus(4)
    monkeypatch.setattr(simhash.links, "__defaults__", (2, tile))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, rep int").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = {d: slow_fingerprint(t or "") for d, t in rows}
    pairs = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = components(prints, pairs)
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_close_fingerprints_meet_across_tiles(spark):
    r = random.Random(6)
    prints = [r.getrandbits(64) for _ in range(40)]
    prints += [p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for p in prints] + [p ^ (7 << r.randrange(60)) for p in prints]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "fp long, rep long"), tile=4).collect()
    want = components(range(len(prints)), [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert components(range(len(prints)), [(e.src, e.dst) for e in edges]) == want


def shingle_set(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split() if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_groups(rows):
    """The smallest id of each group of texts linked by a similarity of 0.8, by comparing all pairs; rows of one id are one document."""
    sets = [(d, shingle_set(t)) for d, t in rows if d is not None]
    pairs = []
    for (a, x), (b, y) in combinations(sets, 2):
        both = len(x & y)
        if x == y or 5 * both >= 4 * (len(x) + len(y) - both):
            pairs.append((a, b))
    return components({d for d, _ in sets}, pairs)


@pytest.mark.parametrize("tile", [32768, 8])
def test_similar_groups_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (0.8, tile, 4 << 20 if tile > 8 else 400))
    r = random.Random(11)
    word = lambda: r.choice("abcdefghijkl") + str(r.randint(0, 60))
    rows = [(i, " ".join(word() for _ in range(r.choice([0, 3, 5, 8, 9, 30, 60, 200])))) for i in range(60)]
    for i in range(60, 300):
        t = (r.choice(rows)[1] or "").split()
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(t))
            t[k : k + r.randint(0, 2)] = [word()] * r.randint(0, 2)
        rows.append((i, " \t".join(t).upper() if r.random() < 0.3 else " ".join(t)))
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "One TWO"), (405, "x " * 30000), (406, rows[5][1]), (406, rows[9][1]), (None, rows[5][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, n int").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    assert got == similar_groups(rows)
    assert len(set(got.values())) < len(got) - 40


def test_similar_groups_of_a_table(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert {x.doc_id: x.component_id for x in simhash.similar(spark.read.parquet(f"{DATA}/documents.parquet")).collect()} == similar_groups(rows)


def test_one_of_each(spark):
    rows = [(1, "a b c d", "p"), (2, "A b c d", "q"), (1, "a b c d", "r"), (None, "a b c d", "s"), (3, "other words here now", None)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert out.columns == ["doc_id", "text", "component_id"]
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3]


def test_empty_tables(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(empty).collect() == []
    assert topk_nra.top_k(empty).collect() == []


# Vectors


def vector_rows(seed=1, n=160, dim=8):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim))
    rows = [(i, (base[i] * r.uniform(0.1, 9)).tolist(), int(r.integers(0, 3))) for i in range(n)]
    for i in range(n, 2 * n):
        j = int(r.integers(0, n))
        rows.append((i, (base[j] + r.standard_normal(dim) * r.choice([0, 0.1, 0.3])).tolist(), rows[j][2] if r.random() < 0.9 else None))
    nan, inf = float("nan"), float("inf")
    odd = [(900, None, 1), (901, [0.0] * dim, 1), (902, [nan] * dim, 1), (903, [inf, *[1.0] * (dim - 1)], 1), (904, [None, *[1.0] * (dim - 1)], 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (950, [3e200, *[1e200] * (dim - 1)], 1)]
    return rows + odd + [(5, rows[5][1], rows[5][2]), (None, rows[5][1], 1)]


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize(("cell", "block"), [(16384, 2048), (20, 7)])
def test_embedding_links_match_brute_force(spark, cell, block):
    rows = vector_rows()
    df = spark.createDataFrame([(*x, "n") for x in rows], "vec_id long, embedding array<double>, label int, n string").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, threshold=0.9, cell=cell, block=block).collect()), key=repr)
    links = {i: set() for i in range(len(rows))}
    for i, j in combinations(range(len(rows)), 2):
        (a, x, p), (b, y, q) = rows[i], rows[j]
        if None in (a, b, p, q) or p != q or not (usable(x) and usable(y)) or len(x) != len(y) or not any(x) or not any(y):
            continue
        u, v = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
        if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.9:
            links[i].add(j)
            links[j].add(i)
    ids = {x[0] for x in rows if x[0] is not None}
    comp = components(ids, [(rows[i][0], rows[j][0]) for i in links for j in links[i]])
    want = [(x[0], len(links[i]), comp.get(x[0]), None if x[0] is None else comp[x[0]] == x[0]) for i, x in enumerate(rows)]
    assert got == sorted(want, key=repr)


def test_cells_hold_all_near_vectors():
    r = np.random.default_rng(9)
    base = r.standard_normal((30, 16))
    x = embedding_dedup.unit_rows(np.repeat(base, 40, axis=0) + 0.25 * r.standard_normal((1200, 16)))
    centres = embedding_dedup.fitted_centres(x, 16, 0.93)
    assert len(centres) > 2
    home, near = embedding_dedup.cells_of(x, centres, 0.93)
    i, j = np.nonzero(x @ x.T >= 0.93)
    assert near[j, home[i]].all() and near.mean() < 0.5
    flat = embedding_dedup.unit_rows(r.standard_normal((800, 64)))
    assert len(embedding_dedup.fitted_centres(flat, 64, 0.93)) == 2


@pytest.mark.parametrize(("shard", "queries"), [(8192, 2048), (30, 3)])
def test_top_k_matches_brute_force(spark, shard, queries):
    rows = [x for x in vector_rows(7) if x[0] != 950]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {}
    for r in topk_nra.top_k(df, 5, 10, shard=shard, queries=queries).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.floor(256 * np.array(v)).astype(int) if v else np.zeros(0, int) for i, v, _ in rows if i is not None and v is not None and (v == [] or usable(v))}
    for q, x in good.items():
        if q % 10 == 0 and len(x):
            scores = sorted((-int(x @ y), i) for i, y in good.items() if i != q and len(y) == len(x))[:5]
            assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)], q


def test_lists_stop_early_and_are_exact():
    r = np.random.default_rng(5)
    x = r.integers(-50, 50, (3000, 6))
    q = r.integers(-50, 50, (40, 6))
    q[0] = 0
    depths = []
    lists = topk_nra.Lists(x)
    read = lists.read
    lists.read = lambda depth: depths.append(depth) or read(depth)
    for i, (rows, scores) in enumerate(lists.top(q, 5, [(0, 0)] * 40)):
        best = sorted(zip((-(x @ q[i])).tolist(), range(3000), strict=True))[:5]
        assert sorted(zip((-scores).tolist(), rows.tolist(), strict=True))[:5] == best
        assert i == 0 or len(rows) < 1500
    assert min(depths) < 3000


def jaccard_links(texts, words=5, least=0.8):
    def shingled(text):
        t = (text or "").encode().lower().split()
        return frozenset(tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1)))

    sets = {i: shingled(t) for i, t in texts.items()}
    return [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least]


def test_pipeline_stage_keeps_one_of_similar_texts(spark):
    import random

    import corpus_pipeline

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = {}
    for g in range(25):
        base = [word() for _ in range(r.choice([3, 30, 120, 600]))]
        texts[100 * g] = " ".join(base)
        for k in range(1, 8):
            other = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                other[r.randrange(len(base))] = word()
            texts[100 * g + k] = " ".join(other)
    texts |= {9000: None, 9001: "", 9002: "  "}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    out = [x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    assert sorted(out) == sorted(set(components(texts, jaccard_links(texts)).values()))


def test_large_components_have_exact_scores(spark):
    r = random.Random(8)
    rows = [(i, [r.randint(-(10**6), 10**6) + r.random() for _ in range(64)]) for i in range(120)]
    rows += [(200, [-x for x in rows[0][1]]), (201, rows[0][1]), (250, rows[50][1])]
    got = topk_nra.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=40).collect()
    whole = {i: [int(256 * x // 1) for x in v] for i, v in rows}
    for q in (0, 50, 100, 200, 250):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q))[:5]
        assert [(x.vec_id, -x.score) for x in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == [(i, s) for s, i in scores]
