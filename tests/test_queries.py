"""Every registered query of the library against SQL on the same tables."""

import pytest

from granary.plans.queries import QUERIES, SQL
from tests.compare import DATA, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    names, want = sql_rows(SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


#: What queries without SQL give; their operators have tests of their own in test_operators.
GIVEN = {
    "caption_levels": [("alt", "Conveyor Indicator Arrows", True, "alt.md"), ("explicit", "what it shows", True, "explicit.md")],
    "image_resolution": [(2, "external", 3, "http://h/x.png", False, "http://h/x.png", 5, "docs/a/One Two.md", 0), (2, "relative", 3, "assets/one_two/twin.png", True, "images/twin.png", 5, "docs/a/One Two.md", 0), (2, "relative", 3, "assets/x.png", True, "img/x.png", 5, "docs/a/One Two.md", 0)],
}
EVERY_DOCUMENT = ["fuzzy_header_footer", "hashed_embeddings", "ingest_report", "normalize_text"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    rows = rows_of(QUERIES[name](spark, DATA))
    assert set(GIVEN.get(name, [])) <= set(rows) and rows
    if name in EVERY_DOCUMENT:
        assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
