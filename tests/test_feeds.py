import json

import pytest
from pyspark.sql import functions as F

from pressmill.plans import ingest
from pressmill.sources import feeds

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="x"><channel><title>c</title>
<item><title>One & two</title><link>https://e.org/1</link><pubDate>Mon, 06 May 2024 07:08:09 GMT</pubDate><description>&lt;b&gt;Bold&lt;/b&gt; text</description>
<category domain="d">Sport</category><category>Local</category><dc:creator>Jane</dc:creator><enclosure url="https://e.org/i.png"/></item>
<item><title>Three</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="text">A</title><link rel="self" href="https://e.org/self"/><link href="https://e.org/a"/>
<updated>2024-05-06T07:08:09Z</updated><summary>s</summary><author><name>Al</name></author><category term="music"/></entry></feed>"""
MAP = """<urlset><url><loc>https://e.org/1</loc><news:news><news:title>T</news:title><news:publication_date>2024-05-06</news:publication_date></news:news></url>
<url><loc>https://e.org/2</loc></url><url><news:news><news:title>U</news:title></news:news></url><url><loc>https://e.org/3</loc><news:news><news:title></news:title></news:news></url>
<url><loc>https://e.org/4</loc><news:news><news:title>V</news:title></news:news></url></urlset>"""


def parsed(spark, rows):
    df = spark.createDataFrame([(i, 2, 3, kind, body) for i, (kind, body) in enumerate(rows)], "id int, publisher_id int, country_id int, feed_type string, body string")
    return {r.id: r["items"] for r in feeds.feed_items(df).collect()}


def test_rss_and_atom(spark):
    got = parsed(spark, [("rss", RSS), ("atom", ATOM), (None, RSS)])
    first, second = got[0]
    assert (first.title, first.link, first.contentSnippet, first.enclosure.url, first.creator) == ("One & two", "https://e.org/1", "Bold text", "https://e.org/i.png", '"Jane"')
    assert [c._VALUE for c in first.categories] == ["Sport", "Local"]
    assert second.title == "Three" and second.link is None
    (entry,) = got[1]
    assert (entry.title, entry.link, entry.isoDate, entry.summary, entry.author) == ("A", "https://e.org/a", "2024-05-06T07:08:09Z", "s", '"Al"')
    assert [c._VALUE for c in entry.categories] == ["music"]
    assert got[2] == got[0]


def test_empty_differs_from_malformed(spark):
    got = parsed(spark, [("rss", "<rss><channel></channel></rss>"), ("rss", "<rss><channel>"), ("rss", None), ("sitemap-news", "<urlset></urlset>"), ("sitemap-news", "<urlset><url>"), ("sitemap-news", "<other/>")])
    assert [got[i] for i in range(6)] == [[], None, None, [], None, []]


def test_sitemap(spark):
    got = parsed(spark, [("sitemap-news", MAP), ("sitemap-news", "<urlset><url><loc>l</loc><news:news><news:title>t</news:title></news:news></url></urlset>"), ("sitemap-news", MAP.replace("T<", "T & U<"))])
    assert [(i.title, i.link, i.isoDate) for i in got[0]] == [("T", "https://e.org/1", "2024-05-06"), ("V", "https://e.org/4", None)]
    assert len(got[1]) == 1
    assert got[2] is None  # sitemaps are not repaired


ITEM = {"title": "A headline", "link": "https://e.org/1", "isoDate": "2024-06-01T00:00:00Z", "contentSnippet": "snippet", "categories": [{"_VALUE": "Government"}]}


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, {"feed_id": 1, "publisher_id": 2, "country_id": 3, "image_url": None, "author": None, "category": "politics", "summary": "snippet"}),
        ({"title": None}, None),
        ({"title": ""}, None),
        ({"title": " "}, {"headline": " "}),
        ({"link": None}, None),
        ({"isoDate": "2024-05-01T00:00:00Z"}, None),
        ({"isoDate": "2024-05-18T00:00:00Z"}, {"category": "politics"}),
        ({"isoDate": "not-a-real-date"}, {"published_at": None}),
        ({"creator": '"Jane Doe"'}, {"author": "Jane Doe"}),
        ({"creator": '{"name": "x"}', "author": '"y"'}, {"author": None}),
        ({"contentSnippet": "x" * 2000}, {"summary": "x" * 1000}),
        ({"contentSnippet": "", "summary": "s"}, {"summary": "s"}),
        ({"contentSnippet": None}, {"summary": ""}),
        ({"enclosure": {"url": ""}}, {"image_url": None}),
    ],
)
def test_article_rows(spark, change, expected):
    from pressmill.schemas import ITEM as kind

    df = spark.createDataFrame([(1, 2, 3, 0, json.dumps(ITEM | change))], "feed_id int, publisher_id int, country_id int, position int, j string")
    rows = ingest.article_rows(df.withColumn("item", F.from_json("j", kind)), F.lit("2024-05-18T00:00:00Z").cast("timestamp")).collect()
    assert (expected is None) == (not rows)
    if rows:
        assert {k: rows[0][k] for k in expected} == expected


def test_fetch_reads_files_and_reports_errors(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    spark.dataSource.register(feeds.FeedSource)
    wanted = [{"url": f"file://{tmp_path}/a.xml"}, {"url": f"file://{tmp_path}/none.xml"}, {"url": "no url"}]
    rows = spark.read.format("feeds").option("feeds", json.dumps(wanted)).option("slots", "2").load().collect()
    assert sorted((r.body is None, r.error is None) for r in rows) == [(False, True), (True, False), (True, False)]


def test_outcomes_and_summary(spark):
    df = spark.createDataFrame(
        [(1, 200, [1], None, "e", "m"), (2, 304, None, None, "e", "m"), (3, None, None, "boom" * 100, None, None), (4, 200, None, None, None, None)],
        "id int, status int, items array<int>, error string, etag string, last_modified string",
    )
    got = {r.id: r.status for r in ingest.outcomes(df).collect()}
    assert got[1] == "ok" and got[2] == "not_modified" and len(got[3]) == 250 and got[4] == "error: not well-formed"
    empty = spark.createDataFrame([], "ok boolean, inserted bigint")
    assert tuple(ingest.summary(empty).head()) == (0, 0, 0)
