"""Page queries on odd pages: they give their SQL's rows."""

import duckdb
import pytest
from conftest import rows_of

from siftwork.plans import page_queries, registry, service_queries  # noqa: F401  (they register the queries)
from siftwork.sources import web

ODD = [
    (1, "http://a.example/1", "<title>Cut &amp</title><p>so much&amp</p><p>&eacute; &lt;b&gt; &copy</p>"),
    (2, "http://a.example/2", "<title>&#233; &amp;lt;</title><p>x &nbsp;&#39;y&#39;</p>"),
]


def against_sql(spark, folder, name, pages):
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    columns, got = rows_of(registry.QUERIES[name](spark, str(folder)))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]})").fetchall()
    return got, sorted(want, key=str)


@pytest.mark.parametrize("name", ["page_main_text", "page_title", "page_observations", "page_evidence"])
def test_references_are_read_as_in_sql(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, ODD)
    assert got == want


CAPTURED = [(i, "http://a.example/1", "<p>same</p>") for i in range(3)] + [(3, "http://a.example/1", "<p>other</p>"), (4, None, "<p>x</p>"), (5, "", "<p>x</p>"), (5, "", "<p>x</p>"), (6, "http://b.example/", None)]


def test_equal_captures_count_each(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "replayed_pages", CAPTURED)
    assert got == want


LINKED = [
    (1, "http://a.example/1", '<a href="/x">a</a><a href="/x">b</a><a href="/y">c</a><a href="/p?a=1&copy=2">d</a>'),
    (2, "http://a.example/1", '<a href="/x">a</a><a href="/z">b</a>'),
]


def test_links_of_captures_of_one_url(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "page_links", LINKED)
    assert got == want  # /y stands behind /z, at place 3, though /x repeats before it
    tied = spark.createDataFrame([(1, "http://a.example/", f'<a href="/{x}">t</a>') for x in "badc"], "page_id long, url string, html string")
    assert [(r.seq, r.link[-1]) for r in web.page_links(tied).orderBy("seq").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
