"""Odd inputs and steps that must not grow faster than their tables."""

import duckdb

from granary.plans.queries import QUERIES, SQL
from tests.compare import plain, rows_of


def against_sql(spark, folder, name, sql=None):
    """(rows of a query, rows of its SQL) over the tables in a folder, as files."""
    c = duckdb.connect()
    for f in folder.iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}/*.parquet')")
    got = QUERIES[name](spark, str(folder))
    return rows_of(got), sorted((tuple(map(plain, r)) for r in c.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({sql or SQL[name]})").fetchall()), key=repr)


def test_phrases_after_other_alphabets(spark, tmp_path):
    texts = ["xéAbc Def Ghi", "ßMotor Speed", "яRack Job 9Tail End", "éPhoto Eye", "_Not This", "9Nor That", "٣Rack Job", "Plain Pair\tAnd More", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = against_sql(spark, tmp_path, "phrase_df")
    assert got == want and ((1, "Abc Def") in got)


def test_fuzzy_headers_compare_only_lines_that_can_win(spark, monkeypatch):
    """Lines of very different lengths, as paragraphs have, cannot have enough votes, so no two of them are compared."""
    from granary.operators import headers

    fill = lambda p, k: "abcdefghij"[k % 10] * (3 + 9 * ((p * 7 + k) % 40))
    rows = [("d", p, "\n".join([f"\tReport page {p}" if p % 4 else f"Report page {p}  ", *(fill(p, k) for k in range(1, 9)), f"-- version v{p} of it --"])) for p in range(60)]
    pages = spark.createDataFrame(rows, "doc string, page long, text string")
    edges = headers.edge_lines(pages)
    every = {(v.doc, v.place, v.text): v.votes for v in headers.votes(edges, pages).collect()}
    some = {(v.doc, v.place, v.text): v.votes for v in headers.votes(edges, pages, every=False).collect()}
    assert all(every[k] == n for k, n in some.items()) and {k for k, n in every.items() if n >= 42} <= set(some)
    assert {k[1] for k in some} == {"h1", "f1"} and {k[1] for k in every} > {"h1", "f1"}
    assert {k: n for k, n in some.items() if k[1] == "h1"} == {("d", "h1", t.split("\n")[0].strip(" ")): 60 for _, _, t in rows}
    out = {r.page: r.text for r in headers.strip_headers(pages).collect()}
    assert out == {p: "\n".join(t.split("\n")[1:-1]) for _, p, t in rows}


def test_conflicts_of_a_title_that_many_have(spark, monkeypatch):
    """A key's pairs are made by many tasks, whatever its documents take in bytes."""
    from pyspark.sql import functions as F

    from granary.operators import ingest

    monkeypatch.setattr(ingest, "BLOCK", 16)
    rows = [(f"{'P' if i % 5 else 'p'}{i // 2}", f"h{i % 9}", "Same" if i < 150 else ("" if i < 160 else None), f"v{i % 3}" if i % 4 else None, str(i % 2)) for i in range(170)]
    docs = spark.createDataFrame(rows, "path string, hash string, title string, framework string, revision string")
    got = ingest.conflicts(docs, docs.withColumn("title", F.upper("title")))
    differ = lambda a, b: bool(a) and bool(b) and a != b
    want = [(a[0], rule, b[0]) for a in rows for b in rows for rule, is_so in (("duplicate", a[1] == b[1] and a[0].lower() != b[0].lower()), ("version", bool(a[2]) and a[2] == b[2] and differ(a[3], b[3])), ("revision", a[0].lower() == b[0].lower() and differ(a[4], b[4]))) if is_so]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    version = got.where("rule = 'version'").groupBy(F.spark_partition_id()).count().collect()
    assert len(version) > 4 and max(v["count"] for v in version) < 0.7 * sum(v["count"] for v in version)


def test_search_reads_texts_where_they_are(spark):
    """Without postings few queries find the same, and neither texts nor postings are shuffled."""
    from granary.operators import retrieval

    rows = [(i, f"Foo.Bar{i % 3} word{i % 7} the_anchor common {'rare_one ' * (i < 5)}long{i % 11}word say {i % 2} times" if i % 13 else "") for i in range(140)]
    chunks = spark.createDataFrame(rows, "id long, search_text string")
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(0, 140, 2)], "id long, dense array<double>")
    asked = ["common rare_one long1word", "the_anchor common", "Foo.Bar1 word3", "rare_one Foo.Bar0 the_anchor", "nowhere at_all", "word3 the_anchor common", ""]
    queries = spark.createDataFrame([(q, t, t, [float(q), 1.0]) for q, t in enumerate(asked)], "qid long, query string, sparse_query string, qvec array<double>")
    posts = retrieval.occurrences(chunks)
    got = lambda df: sorted(map(tuple, df.select("qid", "id", "score", "rank").collect()))
    exact, anchor = (lambda p: retrieval.exact_channel(p, chunks, vectors, queries, 4)), (lambda p: retrieval.anchor_channel(p, vectors, queries, 4, chunks=chunks))
    for run in (exact, anchor, lambda p: retrieval.sparse_channel(p, chunks, queries, 4), lambda p: retrieval.exact_channel(p, chunks, vectors, queries, 500, exhaustive=True)):
        assert got(run(None)) == got(run(posts)) != []
    assert {q for q, *_ in got(anchor(None))} == {0, 2, 3}
    plan = retrieval.containing(None, chunks, queries)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Size" not in plan and plan.count("regexp_extract_all") == 1


def test_terms_are_counted_where_the_texts_are(spark):
    from granary.operators import retrieval, terms

    chunks = spark.createDataFrame([(1, "a b A"), (2, "b"), (3, None), (4, "")], "id long, search_text string")
    counts = retrieval.term_counts(chunks)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, counts.collect())) == [("a", 1, 2), ("b", 2, 2)]
    docs = spark.createDataFrame([(1, "Foo x Foo"), (2, "Foo"), (3, None)], "doc long, text string")
    assert sorted(map(tuple, terms.token_df(docs).collect())) == [("Foo", 2, 1), ("x", 1, 1)]
    assert terms.token_df(docs)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, terms.token_df(docs.union(docs)).collect())) == [("Foo", 2, 1), ("x", 1, 1)]


def test_equal_rectangles_are_compared_once(spark):
    from granary.operators import headers

    columns = "id long, page long, x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([(i, i % 2, 0.0, float(i % 3), 2.0, i % 3 + 1.0) for i in range(60)] + [(60, 0, None, 0.0, 2.0, 1.0)], columns)
    tables = spark.createDataFrame([(i, 0, 0.0, 0.0, 1.0, 1.0) for i in range(50)], columns)
    out = headers.without_covered(blocks, tables)
    assert {v.id for v in out.collect()} == {i for i in range(60) if i % 2 or i % 3} | {60}
    assert out.columns == ["id", "page", "x0", "y0", "x1", "y1", "reading_order"]


def test_chunks_come_in_small_frames():
    import pandas as pd

    from granary.operators import chunking

    whole = pd.DataFrame({"source": [str(i) for i in range(300)], "text": ["some words that are long enough to stay"] * 300})
    frames = list(chunking._markdown(iter([whole])))
    assert [len(f) for f in frames] == [128, 128, 44] and pd.concat(frames)["source"].tolist() == whole["source"].tolist()


def test_words_are_hashed_once(monkeypatch):
    import numpy as np

    from granary.functions import embedding

    seen, digest = [], embedding.xxhash.xxh64_intdigest
    monkeypatch.setattr(embedding.xxhash, "xxh64_intdigest", lambda part: seen.append(part) or digest(part))
    out = embedding.hashed(["rail Rail belt", "belt belt rail", None])
    assert len(seen) == len(set(seen)) and not out[2].any()
    monkeypatch.setattr(embedding, "WORDS_KNOWN", 1)
    assert np.array_equal(embedding.hashed(["rail Rail belt", "belt belt rail", None]), out)
