import random

import pytest
from pyspark.sql import functions as F

from pressmill.functions import dates, text, urls


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).head()[0]


@pytest.mark.parametrize(
    ("headline", "same"), [("  Some   Headline  ", "some headline"), ("Some Headline﻿", "some headline"), (None, ""), ("\t\n", "")]
)
def test_normal_headline(spark, headline, same):
    assert one(spark, headline, text.normal_headline) == same


def test_dedup_hash_known_answer(spark):
    known = "b30aa6498287878dc483247c6515c1490b5aa5be1131a3c2d6b562323564ae81"
    assert one(spark, " Some  headline", lambda v: text.dedup_hash(F.lit(42), v)) == known
    assert one(spark, "some headline", lambda v: text.dedup_hash(F.lit(43), v)) != known
    assert one(spark, None, lambda v: text.dedup_hash(F.lit(42), v))


def test_escape_ampersands(spark):
    given = "Lycee 1 & 2 &amp; more &lt;tag&gt; &#39; &#x27;"
    assert one(spark, given, text.escape_ampersands) == "Lycee 1 &amp; 2 &amp; more &lt;tag&gt; &#39; &#x27;"
    assert one(spark, "plain", text.escape_ampersands) == "plain"
    assert one(spark, "&nbsp; &amp", text.escape_ampersands) == "&amp;nbsp; &amp;amp"


@pytest.mark.parametrize(
    ("texts", "headline", "category"),
    [
        (["Government"], "Some headline", "politics"),
        (["Sport"], "Some headline", "sports"),
        (["Business & Finance"], "Some headline", "business"),
        ([], "President signs new election law", "politics"),
        (None, "Local hospital opens new covid ward", "health"),
        (["Weather"], "It rained today", "other"),
        ([], "", "other"),
        (None, None, "other"),
        (["", "Music"], "headline", "entertainment"),
        ([], "Atlantic storm, an authentic one", "technology"),
        ([], "La santé", "other"),
        ([], "Politics", "other"),
    ],
)
def test_categorize(spark, texts, headline, category):
    df = spark.createDataFrame([(texts, headline)], "t array<string>, h string")
    assert df.select(text.categorize(F.col("t"), F.col("h"))).head()[0] == category


def test_category_texts(spark):
    df = spark.createDataFrame([([("Sport", "x"), (None, "y")],)], "c array<struct<_VALUE:string,_domain:string>>")
    assert df.select(text.category_texts(F.col("c"))).head()[0] == ["Sport", ""]


@pytest.mark.parametrize(
    ("creator", "other", "name"),
    [('"Jane Doe"', None, "Jane Doe"), ('{"name":"x"}', '"Jane"', None), (None, '"Jane"', "Jane"), ('""', '"Jane"', "Jane"), (None, None, None), ("[1]", None, None)],
)
def test_author(spark, creator, other, name):
    df = spark.createDataFrame([(creator, other)], "c string, o string")
    assert df.select(text.author(F.col("c"), F.col("o"))).head()[0] == name


@pytest.mark.parametrize(("given", "limit"), [(None, 30), ("0", 30), ("abc", 30), ("12abc", 12), ("99999", 100), ("-5", -5), ("", 30)])
def test_page_limit(spark, given, limit):
    from pressmill.plans.read_api import page_limit

    assert one(spark, given, text.page_limit) == limit
    assert page_limit(given) == limit


@pytest.mark.parametrize(
    ("words", "risk"),
    [("", "MEDIUM"), ("schema", "HIGH"), ("typo", "LOW"), ("query", "MEDIUM"), ("schema typo", "LOW"), ("schema query", "HIGH"), ("typo query", "MEDIUM"), ("schema typo query", "MEDIUM")],
)
def test_risk_truth_table(spark, words, risk):
    assert one(spark, words, text.risk) == risk


def test_three_domains(spark):
    url = "https://WWW.Example.com:80/a/b"
    assert one(spark, "https://www.Example.com:80/a/b", text.site_with_path) == "Example.com:80/a/b"
    assert one(spark, "https://www.Example.com:80/a/b", text.site) == "Example.com:80"
    assert one(spark, url, text.host) == "example.com"
    assert one(spark, "no url at all", text.host) is None


def test_small_ones(spark):
    assert one(spark, "Hello, World -- again!", text.slug) == "hello-world-again"
    assert one(spark, 29000000, text.thousands, "bigint") == "29 000 000"
    assert one(spark, "fr-ci", text.locale_region) == "CI"
    assert one(spark, "fr", text.locale_region) is None
    assert len(one(spark, "x" * 400, text.error_status)) == 250
    assert one(spark, 1280.0, text.kilobytes, "double") == 1.2
    assert [one(spark, a, text.verdict) for a in (" A", "r", "x", None)] == ["approved", "rejected", None, None]


@pytest.mark.parametrize(
    ("given", "iso"),
    [
        ("2024-05-06T07:08:09Z", "2024-05-06 07:08:09"),
        ("Mon, 06 May 2024 07:08:09 GMT", "2024-05-06 07:08:09"),
        ("6 May 2024 09:08:09 +0200", "2024-05-06 07:08:09"),
        ("Aug 7, 2026", "2026-08-07 00:00:00"),
        ("not-a-real-date", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(spark, given, iso):
    got = one(spark, given, lambda v: F.date_format(dates.parse_date(v), "yyyy-MM-dd HH:mm:ss"))
    assert got == iso


def test_invalid_iso_date_has_no_substitute(spark):
    df = spark.createDataFrame([("x", "2024-05-06T07:08:09Z"), ("", "2024-05-06T07:08:09Z")], "i string, p string")
    assert [r[0] is None for r in df.select(dates.published_at(F.col("i"), F.col("p"))).collect()] == [True, False]


def test_ages(spark):
    row = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' a, TIMESTAMP '2024-01-15 00:00:59' b, CAST(NULL AS TIMESTAMP) c")
    got = row.select(dates.minutes_old(F.col("a"), F.col("b")), dates.days_left(F.col("b"), F.col("a")), dates.days_left(F.col("a"), F.col("b")), dates.is_fresh(F.col("c"), F.col("b")), dates.is_fresh(F.col("b"), F.col("b")), dates.minutes_old(F.col("c"), F.col("a")) > 1000000).head()
    assert list(got) == [20160, 14, -14, True, True, True]


def test_announced_links(spark):
    html = """<LINK REL="alternate" type='application/RSS+xml' HREF="/x"><link rel=alternate type=application/rss+xml href=/y>
    <link rel="alternate" type="text/html" href="/z"><link rel="alternate" type="application/atom+xml" href="/a?b=1">"""
    assert one(spark, html, urls.announced_links) == ["/x", "/a?b=1"]


def test_absolute(spark):
    df = spark.createDataFrame([("https://a.org/b/", "c"), ("https://a.org/b", "/c"), ("nothing", "/c"), (None, "/c"), ("https://a.org", None)], "b string, p string")
    assert [r[0] for r in df.select(urls.absolute("b", "p")).collect()] == ["https://a.org/b/c", "https://a.org/c", None, None, None]


#: What browsers' scripts make of them, in a session of UTC.
DATES = [
    ('Wed, 2 Oct 02 13:00 EST', '2002-10-02 18:00:00'), ('01 March 2024 10:00:00 GMT', '2024-03-01 10:00:00'), ('Fri,01 Mar 2024 10:00:00 GMT', '2024-03-01 10:00:00'),
    ('Mar 1, 2024 10:00', '2024-03-01 10:00:00'), ('2024/03/01', '2024-03-01 00:00:00'), ('2024-03-01', '2024-03-01 00:00:00'),
    ('2024-03-01T10:00:00Z', '2024-03-01 10:00:00'), ('2024-03-01T10:00:00.123Z', '2024-03-01 10:00:00.123'), ('2024-03-01T10:00:00.123456+02:00', '2024-03-01 08:00:00.123'),
    ('2024-03-01T10:00+0530', '2024-03-01 04:30:00'), ('2024-03-01 10:00:00', '2024-03-01 10:00:00'), ('Fri, 01 Mar 2024 10:00:00 +0100', '2024-03-01 09:00:00'),
    ('Fri Mar 01 2024 10:00:00 GMT+0100 (Central European Standard Time)', '2024-03-01 09:00:00'), ('3/1/2024', '2024-03-01 00:00:00'), ('3/1/24 1:05 PM', '2024-03-01 13:05:00'),
    ('12:30 am 1 Mar 2024', '2024-03-01 00:30:00'), ('1-Mar-2024', '2024-03-01 00:00:00'), ('March 2024', '2024-03-01 00:00:00'),
    ('Mar 1', '2001-03-01 00:00:00'), ('2024', '2024-01-01 00:00:00'), ('2024-03', '2024-03-01 00:00:00'),
    ('Feb 30 2024', '2024-03-01 00:00:00'), ('2 Oct 99', '1999-10-02 00:00:00'), ('Mon, 06 May 2024 08:00:00 PDT', '2024-05-06 15:00:00'),
    ('Thursday, March 7, 2024 - 14:05', '2024-03-07 14:05:00'), ('2024-03-01T24:00:00Z', '2024-03-02 00:00:00'), ('Sat, 2 Mar 2024 10:00:00 UT', '2024-03-02 10:00:00'),
    ('1.3.2024', '2024-01-03 00:00:00'), ('2024-03-01T10:00:00-05:00', '2024-03-01 15:00:00'), ('2024-03-01T10:00:00 -0500', '2024-03-01 15:00:00'),
    ('Fri, 1 Mar 2024 10:00:00 GMT-5', '2024-03-01 15:00:00'), ('not-a-real-date', None), ('', None),
    ('yesterday', None), ('13/13/2024', None), ('2024-13-01', None),
    ('Mar 32 2024', None), ('10:00', None), ('1 Mar 2024 25:00', None),
    ('1 Mar 2024 10:61', None), ('1 März 2024 foo', None), ('1709287200', None),
    ('20240301', None), ('1 2 3 4', None), ('1 Mar 2024 10:00 hello', None),
    ('13:00 PM 1 Mar 2024', None), ('   ', None), (None, None),
]


def test_dates_as_scripts_read_them(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "i int, t string")
    got = {r.i: r.at and str(r["at"]) for r in df.select("i", dates.parse_date(F.col("t")).alias("at")).collect()}
    assert [(t, got[i] and got[i].removesuffix("000") if "." in (got[i] or "") else got[i]) for i, (t, _) in enumerate(DATES)] == DATES


@pytest.mark.parametrize(
    ("given", "most", "cut"),
    [("😀" * 600, 1000, "😀" * 500), ("a" + "😀" * 600, 1000, "a" + "😀" * 499 + "\ufffd"), ("é" * 1001, 1000, "é" * 1000), ("😀", 1, "\ufffd"), ("😀", 2, "😀"), ("ab", 5, "ab"), ("", 3, ""), (None, 3, None), ("日本😀語", 4, "日本😀"), ("日本😀語", 3, "日本\ufffd")],
)
def test_code_units(spark, given, most, cut):
    assert one(spark, given, lambda v: text.first_units(v, most)) == cut


BASE = 'https://a.org/x/y/z?q=1#f'
#: What the URL standard makes of a path as seen from a base.
URLS = [
    (BASE, '/feed', 'https://a.org/feed'), (BASE, 'feed', 'https://a.org/x/y/feed'), (BASE, '../feed', 'https://a.org/x/feed'),
    (BASE, './feed/.', 'https://a.org/x/y/feed/'), (BASE, '../../../../feed/..', 'https://a.org/'), (BASE, '?feed=rss2', 'https://a.org/x/y/z?feed=rss2'),
    (BASE, '#top', 'https://a.org/x/y/z?q=1#top'), (BASE, '', 'https://a.org/x/y/z?q=1'), (BASE, '//B.org/p', 'https://b.org/p'),
    (BASE, '\\\\b.org\\p', 'https://b.org/p'), (BASE, '\\p\\q', 'https://a.org/p/q'), (BASE, ' /feed \n', 'https://a.org/feed'),
    (BASE, '/a b', 'https://a.org/a%20b'), (BASE, '/é?é="\'#é`', 'https://a.org/%C3%A9?%C3%A9=%22%27#%C3%A9%60'), (BASE, '/%7e/%2E%2e/x', 'https://a.org/x'),
    (BASE, 'http://A.org:80/', 'http://a.org/'), (BASE, 'HTTPS://A.org:443', 'https://a.org/'), (BASE, 'https:feed', 'https://a.org/x/y/feed'),
    (BASE, 'https:/feed', 'https://a.org/feed'), (BASE, 'http:feed', 'http://feed/'), (BASE, 'http:////b.org//p', 'http://b.org//p'),
    (BASE, 'https://a.org:8443/f', 'https://a.org:8443/f'), (BASE, 'https://a.org:0443/f', 'https://a.org/f'), (BASE, 'https://a.org:70000/f', None),
    (BASE, 'https://a.org:x/f', None), (BASE, 'mailto:x@y.org', 'mailto:x@y.org'), (BASE, 'https://é.org/', 'https://xn--9ca.org/'),
    (BASE, 'https://bücher.例え.テスト/', 'https://xn--bcher-kva.xn--r8jz45g.xn--zckzah/'), (BASE, 'https://Ünïcödé-test.org', 'https://xn--ncd-test-d1a1d7d6c.org/'), (BASE, 'https://u:p w@b.org/', 'https://u:p%20w@b.org/'),
    (BASE, 'https://%61.org/', 'https://a.org/'), (BASE, 'https://a b.org/', None), (BASE, 'https:///', None),
    (BASE, 'https://127.0.0.1:443/x', 'https://127.0.0.1/x'), (BASE, 'https://[2001:DB8::1]/x', 'https://[2001:db8::1]/x'), ('https://a.org', 'feed', 'https://a.org/feed'),
    ('A.org', 'feed', None), ('mailto:x', 'feed', None), (None, 'feed', None),
    (BASE, None, None), ('https://A.org:443\\x\\y', 'z', 'https://a.org/x/z'), (' https://a.org/ ', '\tfe\ned', 'https://a.org/feed'),
    ('https://é.org/é', 'x', 'https://xn--9ca.org/x'), ('https://中文.org/', '/', 'https://xn--fiq228c.org/'), ('https://ñandú-ÑÁ.org', '/', 'https://xn--and--8na5ge4e.org/'),
]


def test_urls_as_the_standard_resolves_them(spark):
    df = spark.createDataFrame([(i, b, p) for i, (b, p, _) in enumerate(URLS)], "i int, b string, p string")
    got = {r.i: r.u for r in df.select("i", urls.absolute(F.col("b"), F.col("p")).alias("u")).collect()}
    assert [(b, p, got[i]) for i, (b, p, _) in enumerate(URLS)] == URLS
    assert "Python" not in df.select(urls.absolute(F.col("b"), F.col("p")))._jdf.queryExecution().executedPlan().toString()


def test_punycode(spark):
    rng = random.Random(1)
    labels = {"".join(rng.choice("abcz-09éüñøßжщ中文日本語😀ก한") for _ in range(rng.randrange(1, 20))) for _ in range(200)}
    df = spark.createDataFrame([(x,) for x in sorted(labels) if not x.isascii()], "x string")
    assert all(r.p == r.x.encode("punycode").decode() for r in df.select("x", urls.punycode(F.col("x")).alias("p")).collect())
