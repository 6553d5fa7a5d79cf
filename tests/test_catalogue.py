import pytest

from pressmill.plans.catalogue import QUERIES, SQL

from .oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, name):
    same(QUERIES[name](spark, tables), tables, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, tables, name):
    assert QUERIES[name](spark, tables).count() > 0


def test_verification_stages(spark, tables):
    rows = {r.id: r for r in QUERIES["verification_chain"](spark, tables).collect()}
    assert {i % 4: (r.verified, r.resolved_url and r.resolved_url.rsplit("/", 1)[1]) for i, r in rows.items()} == {0: (True, "given"), 1: (True, "announced"), 2: (True, "rss.xml"), 3: (False, None)}


def test_feed_documents_keep_titles_as_they_are(spark, tmp_path):
    """References other than &amp; are text, cut ones too, in each kind of document."""
    titles = ["x &quot;y&quot;", "x &quot", "a&&&am", "a & b &amp; c", "&amp;quot; &amp;amp;", "1 < 2 > 0", "&#65;&#x41; &nbsp;", "a ]]> b", "a\u0085b c", "a\rb", "", "a\nb"]
    rows = [(4 * i + kind, f"https://e.org/{i}?a=1&b=2&lt;={kind}", f"<html><title>{t}</title></html>") for i, t in enumerate(titles) for kind in range(4)] + [(1000, "https://e.org/", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    same(QUERIES["feed_documents"](spark, str(tmp_path)), str(tmp_path), SQL["feed_documents"])
