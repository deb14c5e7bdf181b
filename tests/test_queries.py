"""Each query that has SQL is held against DuckDB on the same files."""

import duckdb
import pytest

from quillgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(found):
    return sorted((tuple(map(repr, r)) for r in found))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    wanted = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})")
    assert sorted(duck.sql(catalog.ORACLES[name]).columns) == columns
    got = rows(df.select(*columns).collect())
    assert got == rows(wanted.fetchall())


def test_queries_without_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"provider_extract", "pipeline_document"}


def test_provider_extract_and_document(spark, sf_dir):
    """The customers' messages: every window gives nodes, edges lie between them, and the document has its sections."""
    mined = catalog.QUERIES["provider_extract"](spark, sf_dir).collect()
    assert mined and all(r.n_nodes > 0 for r in mined) and len({(r.source, r.window_ref) for r in mined}) == len(mined)
    (document,) = catalog.QUERIES["pipeline_document"](spark, sf_dir).collect()
    assert document.markdown.startswith("# ") and "## " in document.markdown


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
