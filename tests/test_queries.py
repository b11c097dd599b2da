"""Every query against its SQL, run by an independent engine."""

import os

import duckdb
import pytest

from lodestrata.plans import further_queries, queries  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as from '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the data tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [x[columns].map(str).sort_values(columns).to_numpy().tolist() for x in (got, want)]
    assert rows[0] == rows[1]


def test_fusion_with_many_copies(spark, tmp_path):
    texts = ["MIT copy " * 9] * 60 + ["the longest text of them all " * 9] * 50 + [f"MIT text {i}" for i in range(4)] + ["other " * i for i in range(1, 20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["source", "rank", "text_md5", "score"]
    got, want = queries.QUERIES["retrieval_fusion"](spark, str(tmp_path)).toPandas(), con.sql(queries.SQL["retrieval_fusion"]).df()
    assert len(want) == 12
    assert got[columns].sort_values(columns).to_numpy().tolist() == want[columns].sort_values(columns).to_numpy().tolist()


def test_documents_that_share_a_path(spark, tmp_path):
    rows = [(1, "http://a/b.c", "x" * 10_001), (2, "http://a/b.c", "short"), (3, "http://a/b.c", "short"), (4, None, "no path"), (5, "http://a/d", None), (6, "", "y" * 10_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["id", "file_path", "title", "cut"]
    got, want = queries.QUERIES["document_documents"](spark, str(tmp_path)).toPandas(), con.sql(queries.SQL["document_documents"]).df()
    assert len(want) == 6
    plain = [sorted(str(["" if x is None or x != x else x for x in row]) for row in t[columns].astype(object).where(t[columns].notna(), None).to_numpy().tolist()) for t in (got, want)]
    assert plain[0] == plain[1]


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
