"""The engine's queries over the driver's tables, each with SQL that gives the same rows.

The tables stand in for the news tables: nation and region for countries,
customer for publishers, orders for articles, supplier for feeds, labels and
documents for submissions, events for polls, jobs and requests, pages for
addresses and homepages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import health, moderation, quality, upsert, verification
from ..sources.tables import next_number, read
from ..streaming import ratelimit
from ..scratch import new_path
from . import ingest, pages, read_api

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# -- stand-ins ---------------------------------------------------------------


def _countries(s, d):
    r = read(s, d, "region")
    n = read(s, d, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations, 5 regions
    null = lambda t: F.lit(None).cast(t)
    return n.select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("iso_code"), F.col("n_name").alias("name"), F.col("r_name").alias("region"), null("string").alias("capital"),
        null("bigint").alias("population"), null("array<string>").alias("languages"), null("string").alias("timezone"), null("string").alias("flag_url"), null("double").alias("lat"), null("double").alias("lng"),
    )


def _publishers(s, d):
    status = F.element_at(F.array(*map(F.lit, ["active", "unavailable", "pending"])), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    return read(s, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("country_id"), F.col("c_name").alias("name"), F.lower("c_name").alias("homepage_url"), F.lit(None).cast("string").alias("logo_url"), status.alias("feed_status"), F.col("c_mktsegment").alias("language")
    )


def _articles(s, d):
    o = read(s, d, "orders")
    c = read(s, d, "customer").select(F.col("c_custkey").alias("publisher_id"), F.col("c_nationkey").alias("country_id"))
    dated = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate"))
    own = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("publisher_id"), dated.alias("published_at"), F.col("o_orderpriority").alias("category"), "o_totalprice")
    return own.join(c, "publisher_id")


_ARTICLES = """articles AS (
  SELECT o_orderkey AS id, o_custkey AS publisher_id, c_nationkey AS country_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS published_at,
         o_orderpriority AS category, c_name AS publisher_name, lower(c_name) AS publisher_url, n_name AS iso
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_SHOWN = "id, publisher_id, publisher_name, publisher_url, category, published_at"


def _page(s, d, **more):
    rows = read_api.articles(_articles(s, d), _publishers(s, d), _countries(s, d), "nation_3", **more)
    return rows.select(*_SHOWN.split(", "))


# -- read queries ------------------------------------------------------------


@_query("SELECT n_name AS iso_code, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY name")
def list_countries(s, d):
    return read_api.list_countries(_countries(s, d)).select("iso_code", "name", "region")


@_query("SELECT n_name AS iso_code, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = upper('nation_3')")
def country_by_iso(s, d):
    return read_api.country(_countries(s, d), "nation_3").select("iso_code", "name", "region")


@_query(
    "SELECT c_custkey AS id, c_name AS name, lower(c_name) AS homepage_url, ['active', 'unavailable', 'pending'][c_custkey % 3 + 1] AS feed_status, c_mktsegment AS language FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' ORDER BY name"
)
def country_publishers(s, d):
    return read_api.publishers(_publishers(s, d), _countries(s, d), "Nation_3").drop("logo_url")


@_query(f"WITH {_ARTICLES} SELECT {_SHOWN} FROM articles WHERE iso = 'NATION_3' ORDER BY published_at DESC NULLS LAST, id LIMIT 30")
def country_articles(s, d):
    return _page(s, d)


@_query(f"WITH {_ARTICLES} SELECT {_SHOWN} FROM articles WHERE iso = 'NATION_3' AND category = '2-HIGH' ORDER BY published_at DESC NULLS LAST, id LIMIT 100")
def country_articles_category(s, d):
    return _page(s, d, category="2-HIGH", limit="99999")


@_query(f"WITH {_ARTICLES} SELECT {_SHOWN} FROM articles WHERE iso = 'NATION_3' ORDER BY published_at DESC NULLS LAST, id LIMIT 12 OFFSET 30")
def country_articles_page2(s, d):
    return _page(s, d, limit="12abc", offset="30")


_OFFSETS = [0, 45, 300, 5400]


@_query(f"WITH {_ARTICLES}, o AS (SELECT *, row_number() OVER (ORDER BY published_at DESC NULLS LAST, id) - 1 AS place FROM articles WHERE country_id = 3) SELECT page, id, category, published_at FROM o JOIN (SELECT unnest({_OFFSETS}) AS page) ON place >= page AND place < page + 30")
def deep_pages(s, d):
    """Pages of a country's articles, the first and far ones, by an index of the order."""
    path = new_path(s, "pages")
    pages.build(_articles(s, d).select("id", "country_id", "category", "published_at"), path)
    found = [pages.page(s, path, 3, offset=offset).select(F.lit(offset).alias("page"), "id", "category", "published_at") for offset in _OFFSETS]
    return reduce(DataFrame.unionAll, found)


@_query("SELECT o_orderkey AS id, o_custkey AS publisher_id, c_name AS publisher_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 1234")
def article_by_id(s, d):
    return read_api.article(_articles(s, d), _publishers(s, d), 1234).select("id", "publisher_id", "publisher_name", "o_totalprice")


@_query("SELECT s_suppkey AS id, s_suppkey AS publisher_id, s_nationkey AS country_id, s_name AS publisher_name, 'https://' || lower(s_name) AS feed_url FROM supplier WHERE s_suppkey % 3 = 0")
def active_feeds_plan(s, d):
    sup = read(s, d, "supplier")
    status = F.when(F.col("s_suppkey") % 3 == 0, "active").otherwise("pending")
    null = F.lit(None).cast("string")
    p = sup.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("country_id"), F.col("s_name").alias("name"), status.alias("feed_status"))
    f = sup.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("publisher_id"), F.concat(F.lit("https://"), F.lower("s_name")).alias("feed_url"), F.lit("rss").alias("feed_type"), null.alias("etag"), null.alias("last_modified"))
    return read_api.poll_plan(f, p).select("id", "publisher_id", "country_id", "publisher_name", "feed_url")


def _submissions(s, d):
    docs = read(s, d, "documents").select("doc_id", "lang", "source")
    status = F.when(F.col("quality") == 1, "pending").when(F.col("toxic") == 1, "rejected").otherwise("approved")
    rows = read(s, d, "labels").join(docs, "doc_id")
    null = F.lit(None).cast("string")
    return rows.select(F.col("doc_id").alias("id"), F.pmod("doc_id", F.lit(25)).cast("int").alias("country_id"), F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), "lang").alias("homepage_url"), status.alias("status"), null.alias("reviewer_note"), F.timestamp_seconds(F.col("doc_id") % 1000).alias("submitted_at"), F.lit(None).cast("timestamp").alias("reviewed_at"))


@_query("SELECT doc_id AS id, n_name AS country_name, n_name AS iso_code FROM labels JOIN documents USING (doc_id) JOIN nation ON doc_id % 25 = n_nationkey WHERE quality = 1")
def pending_submissions(s, d):
    return moderation.pending(_submissions(s, d), _countries(s, d)).select("id", "country_name", "iso_code")


# -- inserting once ----------------------------------------------------------

_HASH = r"sha256(source || ':' || lower(regexp_replace(regexp_replace(coalesce(text, ''), '^[\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$', '', 'g'), '[\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')))"
_NEW = f"""WITH h AS (SELECT doc_id, source, {_HASH} AS dedup_hash FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY dedup_hash ORDER BY doc_id) AS k FROM h WHERE doc_id % 2 = 1),
new AS (SELECT doc_id, source, dedup_hash FROM b WHERE k = 1 AND dedup_hash NOT IN (SELECT dedup_hash FROM h WHERE doc_id % 2 = 0))"""


def _hashed(s, d):
    return read(s, d, "documents").select("doc_id", "source", text.dedup_hash(F.col("source"), F.col("text")).alias("dedup_hash"))


@_query(f"SELECT doc_id, {_HASH} AS dedup_hash FROM documents")
def dedup_hash(s, d):
    return _hashed(s, d).select("doc_id", "dedup_hash")


@_query(_NEW + " SELECT doc_id, source, dedup_hash FROM new")
def insert_ignore_batch(s, d):
    h = _hashed(s, d)
    return upsert.insert_ignore(h.where("doc_id % 2 = 0"), h.where("doc_id % 2 = 1"), ["dedup_hash"], ["doc_id"])


@_query(_NEW + " SELECT count(*) AS inserted FROM new")
def insert_ignore_counts(s, d):
    return insert_ignore_batch(s, d).agg(F.count("*").alias("inserted"))


@_query("SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + (SELECT max(c_custkey) FROM customer) AS id FROM orders")
def assign_ids(s, d):
    rows = read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return upsert.with_ids(rows, read(s, d, "customer").select(F.col("c_custkey").alias("id")), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


# -- articles from items -----------------------------------------------------

_WHEN = "CASE " + " ".join(f"WHEN regexp_matches(h, '{'|'.join(words)}') THEN '{name}'" for name, words in text.KEYWORDS.items()) + " ELSE 'other' END"


@_query(f"SELECT doc_id, {_WHEN} AS category FROM (SELECT doc_id, lower(source || ' ' || coalesce(text, '')) AS h FROM documents)")
def categorize_docs(s, d):
    return read(s, d, "documents").select("doc_id", text.categorize(F.array("source"), F.col("text")).alias("category"))


_PARTS = {"politics": ["red"], "business": ["blue"], "technology": ["gizmo"], "sports": ["ring"], "health": ["promo"], "entertainment": ["economy"]}
_PART_WHEN = "CASE " + " ".join(f"WHEN contains(h, '{words[0]}') THEN '{name}'" for name, words in _PARTS.items()) + " ELSE 'other' END"


@_query(f"SELECT p_partkey, {_PART_WHEN} AS category FROM (SELECT p_partkey, lower(p_type || ' ' || p_name) AS h FROM part)")
def categorize_parts(s, d):
    return read(s, d, "part").select("p_partkey", text.categorize(F.array("p_type"), F.col("p_name"), _PARTS).alias("category"))


@_query(
    r"SELECT page_id, sha256(regexp_replace(replace(html, '&', '&amp;'), '&amp;((amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)', '&\1', 'g')) AS repaired FROM pages"
)
def escape_ampersands(s, d):
    return read(s, d, "pages").select("page_id", F.sha2(text.escape_ampersands(F.col("html")), 256).alias("repaired"))


@_query("SELECT doc_id, substr(coalesce(nullif(CASE WHEN doc_id % 5 <> 0 THEN text ELSE '' END, ''), nullif(lang, ''), ''), 1, 1000) AS summary FROM documents")
def summary_truncate(s, d):
    snippet = F.when(F.col("doc_id") % 5 != 0, F.col("text")).otherwise("")
    return read(s, d, "documents").select("doc_id", text.summary(snippet, F.col("lang")).alias("summary"))


_LATEST = "(SELECT max(ts) FROM events)"


_DATES = [  # a form, what follows it, what it keeps of an instant, and hours from UTC
    ("EEE, d MMM yy HH:mm", " EST", "minute", -5), ("dd MMMM yyyy HH:mm:ss", " GMT", "second", 0), ("EEE,dd MMM yyyy HH:mm:ss", " +0230", "second", 2.5), ("MMM d, yyyy HH:mm", "", "minute", 0), ("yyyy/MM/dd", "", "day", 0),
    ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "", "millisecond", 0), ("M/d/yy h:mm a", "", "minute", 0), ("d-MMM-yyyy", "", "day", 0), ("EEE MMM dd yyyy HH:mm:ss", " GMT-0400 (Somewhere)", "second", -4), ("'no date'", "", None, 0),
]


@_query("SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN " + (f"CAST(date_trunc('{keeps}', ts) AS TIMESTAMP) - to_minutes({round(60 * away)})" if keeps else "NULL") for i, (_, _, keeps, away) in enumerate(_DATES)) + " END AS published_at FROM events")
def parse_dates(s, d):
    """Instants written in the forms that feeds carry, and read again."""
    e = read(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    text_of = F.coalesce(*[F.when(F.col("event_id") % 10 == i, F.concat(F.date_format("at", form), F.lit(more))) for i, (form, more, _, _) in enumerate(_DATES)])
    return e.select("event_id", dates.parse_date(text_of).cast("timestamp_ntz").alias("published_at"))


@_query("""
WITH t AS (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), 'a', '😀'), 'e', '𝄞'), '') AS w FROM documents),
c AS (SELECT doc_id, i, w[i] AS ch FROM (SELECT doc_id, w, unnest(range(1, least(len(w), 1000) + 1)) AS i FROM t)),
u AS (SELECT doc_id, i, ch, sum(CASE WHEN unicode(ch) > 65535 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS upto, CASE WHEN unicode(ch) > 65535 THEN 2 ELSE 1 END AS size FROM c)
SELECT doc_id, coalesce(string_agg(CASE WHEN upto <= 1000 THEN ch ELSE chr(65533) END, '' ORDER BY i) FILTER (upto - size < 1000), '') AS summary
FROM t LEFT JOIN u USING (doc_id) GROUP BY doc_id
""")
def summary_utf16(s, d):
    """Summaries of texts with characters beyond U+FFFF, some of them on the cut."""
    astral = F.replace(F.replace("text", F.lit("a"), F.lit("😀")), F.lit("e"), F.lit("𝄞"))
    return read(s, d, "documents").select("doc_id", text.summary(astral, F.lit(None).cast("string")).alias("summary"))


_LINKS = ["/feed", "feed.xml", "../feed", "?feed=rss2", "#é", "//B.Example:443\\x y", "", " a/./b/../c\n", "HTTP://É.org:80/%7e", "https://a.org:99999/"]


@_query(r"""
WITH u AS (
  SELECT page_id, regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
         regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS q FROM pages
), f AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS folder FROM u)
SELECT page_id, CASE page_id % 10
  WHEN 0 THEN site || '/feed' WHEN 1 THEN site || folder || 'feed.xml' WHEN 2 THEN site || regexp_replace(folder, '[^/]+/$', '') || 'feed' WHEN 3 THEN site || path || '?feed=rss2' WHEN 4 THEN site || path || q || '#%C3%A9'
  WHEN 5 THEN scheme || '://b.example' || CASE scheme WHEN 'http' THEN ':443' ELSE '' END || '/x%20y' WHEN 6 THEN site || path || q WHEN 7 THEN site || folder || 'a/c' WHEN 8 THEN 'http://xn--9ca.org/%7e' END AS url FROM f
""")
def resolve_urls(s, d):
    """Links of pages as seen from the pages' addresses."""
    link = F.get(F.array(*map(F.lit, _LINKS)), F.col("page_id").cast("int") % 10)
    return read(s, d, "pages").select("page_id", urls.absolute(F.col("url"), link).alias("url"))


@_query(f"SELECT event_id, ts FROM events WHERE ts IS NULL OR ts >= {_LATEST} - INTERVAL 14 DAY")
def fresh_filter(s, d):
    e = read(s, d, "events").select("event_id", "ts")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return e.join(F.broadcast(now)).where(dates.is_fresh(F.col("ts"), dates.cutoff(F.col("now")))).drop("now")


@_query("SELECT id, published_at FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS published_at FROM orders) WHERE published_at IS NULL OR published_at >= TIMESTAMP '1998-06-01' - INTERVAL 14 DAY")
def fresh_filter_null_kept(s, d):
    rows = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("published_at"))
    return rows.where(dates.is_fresh(F.col("published_at"), dates.cutoff(F.lit("1998-06-01").cast("timestamp_ntz"))))


@_query("SELECT doc_id FROM documents WHERE coalesce(CASE WHEN doc_id % 7 <> 0 THEN text ELSE '' END, '') <> '' AND coalesce(CASE WHEN doc_id % 11 <> 0 THEN source END, '') <> ''")
def required_fields(s, d):
    title, link = F.when(F.col("doc_id") % 7 != 0, F.col("text")).otherwise(""), F.when(F.col("doc_id") % 11 != 0, F.col("source"))
    return read(s, d, "documents").where(text.filled(title).isNotNull() & text.filled(link).isNotNull()).select("doc_id")


_ITEMS = f"""WITH i AS (
  SELECT doc_id, source, lang, text, CASE WHEN doc_id % 3 = 0 THEN 'not a date' WHEN doc_id % 3 = 1 THEN strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 40 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM documents),
p AS (SELECT *, CASE WHEN doc_id % 3 = 1 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 40 AS INTEGER)) END AS published_at, {_HASH} AS dedup_hash, lower(lang || ' ' || coalesce(text, '')) AS h FROM i)
"""


def _items(s, d):
    iso = F.when(F.col("doc_id") % 3 == 0, "not a date").when(F.col("doc_id") % 3 == 1, F.date_format(F.timestamp_seconds(1704067200 + (F.col("doc_id") % 40) * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    null = F.lit(None).cast("string")
    item = F.struct(
        F.col("text").alias("title"), F.concat(F.lit("https://example.com/"), "doc_id").alias("link"), iso.alias("isoDate"), null.alias("pubDate"), F.col("text").alias("contentSnippet"), null.alias("summary"),
        F.struct(null.alias("url")).alias("enclosure"), F.to_json(F.struct("lang")).alias("creator"), F.concat(F.lit('"'), "source", F.lit('"')).alias("author"),
        F.array(F.struct(F.col("lang").alias("_VALUE"), null.alias("_domain"))).alias("categories"),
    )
    return read(s, d, "documents").select(F.col("doc_id").alias("feed_id"), F.col("source").alias("publisher_id"), F.lit(0).alias("country_id"), F.lit(0).alias("position"), item.alias("item"))


@_query(
    _ITEMS
    + f"SELECT doc_id AS feed_id, sha256(text) AS headline, substr(text, 1, 1000) AS summary, 'https://example.com/' || doc_id AS original_url, CAST(NULL AS VARCHAR) AS author, {_WHEN} AS category, published_at, dedup_hash FROM p WHERE coalesce(text, '') <> '' AND (published_at IS NULL OR published_at >= TIMESTAMP '2024-01-20' - INTERVAL 14 DAY)"
)
def build_article_rows(s, d):
    rows = ingest.article_rows(_items(s, d), dates.cutoff(F.lit("2024-01-20T00:00:00Z").cast("timestamp")))
    published = F.timestamp_seconds(F.unix_seconds("published_at")).cast("timestamp_ntz")
    return rows.select("feed_id", F.sha2("headline", 256).alias("headline"), "summary", "original_url", "author", "category", published.alias("published_at"), "dedup_hash")


# -- order, addresses, names -------------------------------------------------


@_query("SELECT row_number() OVER (ORDER BY p DESC NULLS LAST, id) AS place_desc, row_number() OVER (ORDER BY p ASC NULLS LAST, id) AS place_asc, id FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS p FROM orders)")
def null_order_both(s, d):
    """All orders, numbered within ranges of either order."""
    rows = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("p"))
    none = s.createDataFrame([], "place_desc bigint, place_asc bigint")
    down = upsert.with_ids(rows, none, [F.desc_nulls_last("p"), "id"], "place_desc")
    return upsert.with_ids(down, none, [F.asc_nulls_last("p"), "id"], "place_asc").drop("p")


@_query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders")
def article_ordinals(s, d):
    rows = quality.ordinals(read(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return rows.select("o_orderkey", F.col("ordinal").cast("bigint").alias("ordinal"))


_SITE_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', '')"
_SITE = f"regexp_replace({_SITE_PATH}, '/.*$', '')"
_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"


@_query(f"SELECT page_id, {_SITE_PATH} AS domain FROM pages")
def domain_v1(s, d):
    return read(s, d, "pages").select("page_id", text.site_with_path(F.col("url")).alias("domain"))


@_query(f"SELECT page_id, {_SITE} AS domain FROM pages")
def domain_v2(s, d):
    return read(s, d, "pages").select("page_id", text.site(F.col("url")).alias("domain"))


@_query(f"SELECT page_id, {_HOST} AS domain FROM pages")
def domain_v3(s, d):
    return read(s, d, "pages").select("page_id", text.host(F.col("url")).alias("domain"))


_DOMAINS = f"WITH p AS (SELECT page_id, {_HOST} AS domain, 'page' || page_id AS name, upper(substr(md5(url), 1, 2)) AS iso FROM pages)"


def _domains(s, d):
    return read(s, d, "pages").select(text.host(F.col("url")).alias("domain"), F.concat(F.lit("page"), "page_id").alias("name"), F.upper(F.substring(F.md5("url"), 1, 2)).alias("iso"))


@_query(_DOMAINS + " SELECT domain, count(*) AS n FROM p GROUP BY domain HAVING count(*) > 1")
def domains_multi(s, d):
    return quality.shared_domains(_domains(s, d), "domain", "name", "iso").select("domain", "n")


@_query(_DOMAINS + " SELECT domain, count(*) AS n, string_agg(name || ' (' || iso || ')', ', ' ORDER BY iso, name) AS listing FROM p GROUP BY domain HAVING count(*) > 1")
def domain_listing(s, d):
    return quality.shared_domains(_domains(s, d), "domain", "name", "iso")


_NAMES = "WITH n AS (SELECT p_brand AS g, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_type ELSE p_name END AS name FROM part), u AS (SELECT DISTINCT g, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM n)"


@_query(_NAMES + " SELECT a.g AS \"group\", a.name AS name_a, b.name AS name_b FROM u a JOIN u b ON a.g = b.g AND a.name < b.name AND a.k <> b.k AND (contains(a.k, b.k) OR contains(b.k, a.k))")
def near_dup_names(s, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name"))
    rows = read(s, d, "part").select("p_brand", name.alias("name")).distinct()
    return quality.similar_names(rows, "p_brand", "name", ["name"])


# -- submissions -------------------------------------------------------------


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT doc_id FROM labels WHERE quality = 1) OR o_orderkey IN (SELECT s_suppkey FROM supplier)")
def existing_or_pending(s, d):
    asked = read(s, d, "orders").select(F.col("o_orderkey").alias("feed_url"))
    feeds = read(s, d, "supplier").select(F.col("s_suppkey").alias("feed_url"))
    waiting = read(s, d, "labels").select(F.col("doc_id").alias("feed_url"), F.when(F.col("quality") == 1, "pending").otherwise("approved").alias("status"))
    return moderation.already_known(asked, feeds, waiting).select(F.col("feed_url").alias("o_orderkey"))


_STATUS = "CASE WHEN quality = 1 THEN 'pending' WHEN toxic = 1 THEN 'rejected' ELSE 'approved' END"


@_query(
    f"SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE {_STATUS} END AS status, CASE WHEN doc_id % 4 = 1 AND doc_id % 8 = 1 THEN 'no feed' END AS reviewer_note, doc_id % 4 < 2 AS reviewed FROM labels JOIN documents USING (doc_id)"
)
def approve_reject(s, d):
    subs = _submissions(s, d)
    answer = F.element_at(F.array(*map(F.lit, [" A ", "r", "s", ""])), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    status = text.verdict(answer)
    decided = subs.select("id", status.alias("status"), F.when((status == "rejected") & (F.col("id") % 8 == 1), "no feed").alias("note")).where(F.col("status").isNotNull())
    done = moderation.reviewed(subs, decided, F.current_timestamp())
    return done.select("id", "status", "reviewer_note", F.col("reviewed_at").isNotNull().alias("reviewed"))


@_query(
    "SELECT doc_id AS id, doc_id % 25 AS country_id, source || '.example.com' AS domain FROM labels JOIN documents USING (doc_id) WHERE quality = 0 AND toxic = 0"
)
def approved_publishers(s, d):
    rows = _submissions(s, d).withColumns({"name": F.col("id"), "language": F.lit("en"), "feed_url": F.lit(""), "feed_type": F.lit("rss")})
    return moderation.approved_publishers(rows).select(F.col("name").alias("id"), F.col("country_id").cast("bigint").alias("country_id"), "domain")


@_query(r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\b[^>]*>')) AS n, nullif(regexp_extract(regexp_extract(html, '(?i)<a\b[^>]*>'), '(?i)href\s*=\s*["'']([^"'']+)["'']', 1), '') AS first_href FROM pages""")
def html_tags(s, d):
    found = urls.tags(F.col("html"), "a")
    return read(s, d, "pages").select("page_id", F.size(found).cast("bigint").alias("n"), urls.attribute(F.try_element_at(found, F.lit(1)), "href").alias("first_href"))


@_query(
    "SELECT page_id, arg_min(path, place) AS path FROM (SELECT page_id, place, path FROM pages, (VALUES "
    + ", ".join(f"({i}, '{p}')" for i, p in enumerate(urls.FEED_PATHS))
    + ") v(place, path) WHERE (page_id + length(path)) % 4 = 0) GROUP BY page_id"
)
def candidate_paths_first(s, d):
    each = read(s, d, "pages").select("page_id", F.posexplode(F.array(*map(F.lit, urls.FEED_PATHS))).alias("place", "path"))
    return each.where((F.col("page_id") + F.length("path")) % 4 == 0).groupBy("page_id").agg(F.min_by("path", "place").alias("path"))


# -- polls and health --------------------------------------------------------


@_query("SELECT count(*) AS feeds, count(*) FILTER (event_type <> 'error') AS ok, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN event_id % 7 END), 0) AS BIGINT) AS inserted FROM events")
def poll_summary(s, d):
    inserted = F.when(F.col("event_type") == "purchase", F.col("event_id") % 7)
    return ingest.summary(read(s, d, "events").select((F.col("event_type") != "error").alias("ok"), inserted.alias("inserted")))


@_query(
    """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, arg_max(event_id, (ts, event_id)) AS e FROM events GROUP BY user_id)
SELECT s_suppkey AS id, CASE WHEN t IS NULL THEN NULL WHEN t = 'error' THEN 'error: ' || e WHEN t = 'view' THEN 'not_modified' ELSE 'ok' END AS last_status,
  CASE WHEN t IN ('click', 'signup', 'purchase') THEN CASE WHEN e % 2 = 0 THEN 'tag' || e END ELSE 'old' END AS etag
FROM supplier LEFT JOIN l ON s_suppkey = user_id"""
)
def feed_status_merge(s, d):
    e = read(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("l"))
    kind = F.col("l.event_type")
    status = F.when(kind == "error", text.error_status(F.col("l.event_id").cast("string"))).when(kind == "view", "not_modified").otherwise("ok")
    polls = e.select("id", status.alias("status"), F.when(F.col("l.event_id") % 2 == 0, F.concat(F.lit("tag"), "l.event_id")).alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    null = F.lit(None).cast("string")
    feeds = read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), null.cast("timestamp").alias("last_fetched_at"), null.alias("last_status"), F.lit("old").alias("etag"), null.alias("last_modified"))
    return upsert.merge_poll_status(feeds, polls, F.current_timestamp()).select("id", "last_status", "etag")


def _jobs(s, d):
    e = read(s, d, "events")
    owners = F.when(F.col("event_type") != "click", F.array(F.concat(F.lit("worker"), (F.col("user_id") % 3)))).otherwise(F.array().cast("array<string>"))
    return e.select(F.col("event_id").alias("name"), F.col("ts").alias("created"), (F.col("event_type") == "purchase").cast("int").alias("succeeded"), owners.alias("owners"))


@_query("SELECT arg_max(event_id, (ts, event_id)) AS name, max(ts) AS created, arg_max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, (ts, event_id)) AS succeeded FROM events WHERE event_type <> 'click' AND user_id % 3 = 1")
def latest_job(s, d):
    return health.latest_job(_jobs(s, d), "worker1")


@_query(
    f"""SELECT event_id AS name, CASE WHEN event_type = 'purchase' AND age < 20 THEN 'ok' WHEN age < 3 THEN 'running' ELSE 'failed' END AS state
FROM (SELECT event_id, event_type, floor((epoch_us({_LATEST}) // 1000000 - epoch_us(ts) // 1000000) / 60) AS age FROM events)"""
)
def job_health(s, d):
    rows = _jobs(s, d)
    now = rows.agg(F.max("created").alias("now"))
    return rows.join(F.broadcast(now)).select("name", health.job_state(F.col("created"), F.col("succeeded"), F.col("now")).alias("state"))


def _containers(s, d):
    reason = F.when(F.col("event_type") == "error", health.CRASH)
    return read(s, d, "events").select(F.col("user_id").alias("pod"), F.col("event_id").alias("container"), reason.alias("reason"))


@_query("SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def crash_per_container(s, d):
    return health.crashing_containers(_containers(s, d))


@_query("SELECT count(DISTINCT user_id) AS n FROM events WHERE event_type = 'error'")
def crash_per_pod(s, d):
    return health.crashing_pods(_containers(s, d))


@_query("SELECT count(*) FILTER (event_type IN ('click', 'signup')) AS passed, count(*) FILTER (event_type IN ('error', 'purchase')) AS failed, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type IN ('error', 'purchase')) = 0 AS healthy FROM events")
def check_tally(s, d):
    kind = F.col("event_type")
    return health.tally(read(s, d, "events").select(health.checked(kind == "view", kind.isin("click", "signup")).alias("state")))


@_query("SELECT user_id, hour, n FROM (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL) WHERE n > 1")
def fixed_window_rate(s, d):
    """Requests by whole hours, of clients with more than one. The limiter's own windows are in rate_limit_log."""
    n = read(s, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    return n.where("n > 1")


@_query("""
WITH RECURSIVE r AS (
  SELECT event_id, user_id, event_type = 'signup' AS registers, ts, row_number() OVER (PARTITION BY user_id, event_type = 'signup' ORDER BY ts, event_id) AS n,
         CASE WHEN event_type = 'signup' THEN 2 ELSE 3 END AS most, CASE WHEN event_type = 'signup' THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END AS long
  FROM events
), w AS (
  SELECT event_id, user_id, registers, n, ts AS opened, 1 AS nth, most FROM r WHERE n = 1
  UNION ALL
  SELECT r.event_id, r.user_id, r.registers, r.n, CASE WHEN r.ts >= w.opened + r.long THEN r.ts ELSE w.opened END, CASE WHEN r.ts >= w.opened + r.long THEN 1 ELSE w.nth + 1 END, r.most
  FROM w JOIN r ON r.user_id = w.user_id AND r.registers = w.registers AND r.n = w.n + 1
)
SELECT event_id, user_id, registers, opened, CAST(nth AS BIGINT) AS nth, CASE WHEN nth <= most THEN 200 ELSE 429 END AS status FROM w
""")
def rate_limit_log(s, d):
    """Which requests of a log the limiter lets through: two limits, one for registrations, with windows that open with a client's first request."""
    registers = F.col("event_type") == "signup"
    rows = read(s, d, "events").select(
        F.struct("user_id", registers.alias("registers")).alias("client"), F.col("ts").cast("timestamp").alias("at"), "event_id",
        F.when(registers, 2).otherwise(3).alias("most"), F.when(registers, 7 * 86400).otherwise(86400).alias("seconds"),
    )
    found = ratelimit.log_limited(rows, ["event_id"])
    return found.select("event_id", "client.user_id", "client.registers", F.col("opened").cast("timestamp_ntz").alias("opened"), "nth", "status")


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AND CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS large FROM events")
def json_props(s, d):
    k = F.from_json("props", "k bigint")["k"]
    return read(s, d, "events").select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("large"))


# -- upserts -----------------------------------------------------------------


def _batch(s, d):
    """New states of half the customers, and customers that are not known yet."""
    c = read(s, d, "customer")
    changed = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), ((F.col("c_nationkey") + 1) % 25).alias("c_nationkey"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lower("c_mktsegment").alias("c_mktsegment"))
    return changed.withColumn("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") + 1_000_000).otherwise(F.col("c_custkey")))


def _upsert_sql(update: list[str]) -> str:
    columns = ", ".join(
        f"CASE WHEN {'b.k IS NOT NULL' if c in update else 'e.c_custkey IS NULL'} THEN b.{c} ELSE e.{c} END AS {c}" for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    )
    return f"""WITH b AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS k, c_name || '*' AS c_name, CAST((c_nationkey + 1) % 25 AS INTEGER) AS c_nationkey,
  CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 END AS c_acctbal, lower(c_mktsegment) AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(e.c_custkey, b.k) AS c_custkey, {columns} FROM customer e FULL JOIN b ON e.c_custkey = b.k"""


_ALL = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@_query(_upsert_sql(_ALL))
def upsert_all(s, d):
    return upsert.upsert(read(s, d, "customer"), _batch(s, d), ["c_custkey"], _ALL)


@_query(_upsert_sql(["c_acctbal", "c_mktsegment"]))
def upsert_subset(s, d):
    return upsert.upsert(read(s, d, "customer"), _batch(s, d), ["c_custkey"], ["c_acctbal", "c_mktsegment"])


@_query(_upsert_sql(["c_acctbal"]))
def upsert_one(s, d):
    return upsert.upsert(read(s, d, "customer"), _batch(s, d), ["c_custkey"], ["c_acctbal"])


# -- data quality ------------------------------------------------------------


@_query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def dq_unique(s, d):
    return quality.duplicates(read(s, d, "nation"), ["n_regionkey"])


@_query("SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment")
def dq_enum(s, d):
    return quality.outside(read(s, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def dq_fk(s, d):
    return quality.orphans(read(s, d, "orders"), "o_custkey", read(s, d, "customer").where("c_custkey % 3 <> 0"), "c_custkey").select("o_orderkey", "o_custkey")


@_query("SELECT count(*) FILTER (text IS NULL) AS text, count(*) FILTER (CASE WHEN doc_id % 9 <> 0 THEN lang END IS NULL) AS lang FROM documents")
def dq_not_null(s, d):
    return quality.nulls(read(s, d, "documents").select("text", F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang")), ["text", "lang"])


# -- small functions ---------------------------------------------------------


@_query("SELECT o_orderkey, replace(format('{:,}', CAST(o_totalprice * 100 AS BIGINT)), ',', ' ') AS shown FROM orders")
def thousands_space(s, d):
    return read(s, d, "orders").select("o_orderkey", text.thousands((F.col("o_totalprice") * 100).cast("decimal(20,0)").cast("bigint")).alias("shown"))


@_query("SELECT p_partkey, rtrim(substr(regexp_replace(lower(regexp_replace(p_brand || ' / ' || p_name || ' (' || p_type || ')', '[^a-zA-Z0-9]', '-', 'g')), '-+', '-', 'g'), 1, 40), '-') AS slug FROM part")
def slugify(s, d):
    return read(s, d, "part").select("p_partkey", text.slug(F.concat("p_brand", F.lit(" / "), "p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"))


_GIVEN = ["", "0", "abc", "12abc", "99999", " 7", "-5"]


@_query(
    "SELECT doc_id, CAST(least(coalesce(nullif(TRY_CAST(regexp_extract(g, '^\\s*([+-]?\\d+)', 1) AS INTEGER), 0), 30), 100) AS INTEGER) AS page_limit FROM (SELECT doc_id, CASE WHEN doc_id % 8 < 7 THEN ["
    + ", ".join(f"'{g}'" for g in _GIVEN)
    + "][doc_id % 8 + 1] || ' ' || coalesce(text, '') ELSE text END AS g FROM documents)"
)
def parse_limit(s, d):
    given = F.try_element_at(F.array(*map(F.lit, _GIVEN)), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    asked = F.coalesce(F.concat(given, F.lit(" "), F.coalesce("text", F.lit(""))), "text")
    return read(s, d, "documents").select("doc_id", text.page_limit(asked).alias("page_limit"))


_CHANGES = ["", "schema change", "typo in readme", "new api endpoint", "schema typo", "secret query", "css of the globe", "auth label of a route"]
_MATCH = lambda p: "regexp_matches(t, '" + "|".join(p) + "')"


@_query(
    f"SELECT doc_id, CASE WHEN {_MATCH(text.HIGH_RISK)} AND NOT {_MATCH(text.LOW_RISK)} THEN 'HIGH' WHEN {_MATCH(text.LOW_RISK)} AND NOT {_MATCH(text.MEDIUM_RISK)} THEN 'LOW' ELSE 'MEDIUM' END AS risk FROM (SELECT doc_id, lower(["
    + ", ".join(f"'{c}'" for c in _CHANGES)
    + "][doc_id % 8 + 1] || ' ' || coalesce(text, '')) AS t FROM documents)"
)
def risk_classify(s, d):
    """Whole texts behind phrases that tell the kinds of a change."""
    change = F.element_at(F.array(*map(F.lit, _CHANGES)), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    return read(s, d, "documents").select("doc_id", text.risk(F.concat(change, F.lit(" "), F.coalesce("text", F.lit("")))).alias("risk"))


@_query(
    """SELECT c_custkey, coalesce(a.n_name, b.n_name, c.n_name) AS country FROM customer
LEFT JOIN nation a ON c_custkey % 3 = 0 AND a.n_nationkey = c_custkey % 40 LEFT JOIN nation b ON c_custkey % 2 = 0 AND b.n_nationkey = customer.c_nationkey
LEFT JOIN nation c ON c_custkey % 5 = 0 AND c.n_nationkey = c_custkey % 30"""
)
def country_fallback(s, d):
    """What a reader chose before, where the address is, or what the locale says: the first that is a country."""
    named = lambda n: F.concat(F.lit("nation_"), n)
    k = F.col("c_custkey")
    asked = read(s, d, "customer").select(
        "c_custkey", F.when(k % 3 == 0, named(k % 40)).alias("saved"), F.when(k % 2 == 0, named(F.col("c_nationkey"))).alias("by_ip"), F.when(k % 5 == 0, named(k % 30)).alias("by_locale")
    )
    return read_api.choose_country(asked, _countries(s, d)).select("c_custkey", "country")


@_query("SELECT o_custkey AS publisher_id, count(*) AS n FROM orders GROUP BY o_custkey")
def publisher_article_counts(s, d):
    return _articles(s, d).groupBy("publisher_id").agg(F.count("*").alias("n"))


@_query("SELECT count(*) + 1 AS next_number FROM supplier")
def next_build_number(s, d):
    return next_number(read(s, d, "supplier"))


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) END AS region FROM documents")
def locale_region(s, d):
    locale = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("fr-"), "lang")).otherwise("fr")
    return read(s, d, "documents").select("doc_id", text.locale_region(locale).alias("region"))


@_query("SELECT page_id, len(html) - len(replace(html, '<p>', '')) AS chars, CAST((len(html) - len(replace(html, '<p>', ''))) / 3 AS BIGINT) AS n FROM pages")
def literal_occurrences(s, d):
    n = text.occurrences(F.col("html"), "<p>").cast("bigint")
    return read(s, d, "pages").select("page_id", (n * 3).alias("chars"), n.alias("n"))


_TITLE = "trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'))"


@_query(
    f"""WITH i AS (SELECT page_id, url, {_TITLE} AS title FROM pages WHERE page_id % 4 <> 3),
p AS (SELECT *, CAST(page_id % 9 AS VARCHAR) AS source, title AS text, lower(title) AS h FROM i WHERE title <> '')
SELECT page_id AS feed_id, title AS headline, url AS original_url, {_WHEN} AS category, {_HASH} AS dedup_hash FROM p"""
)
def feed_documents(s, d):
    """Pages as items of RSS, Atom and news sitemaps, and of documents that are cut off; parsed back and made article rows."""
    from ..sources.feeds import feed_items

    p = read(s, d, "pages")
    title, kind = F.replace(F.regexp_extract("html", r"<title>([^\n]*?)</title>", 1), F.lit("&amp;"), F.lit("&")), F.col("page_id") % 4
    marked = lambda t: reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), [("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")], t)
    strict = lambda t: marked(F.replace(t, F.lit("&"), F.lit("&amp;")))
    # ampersands stay bare, but where that would make a reference of what is none
    bare = lambda t: marked(F.regexp_replace(t, f"&(?={text.REFERENCE})", "&amp;"))
    link = strict(F.col("url"))
    rss = F.concat(F.lit("<rss><channel><item><title>"), bare(title), F.lit("</title><link>"), bare(F.col("url")), F.lit("</link></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>"), strict(title), F.lit('</title><link href="'), link, F.lit('"/></entry></feed>'))
    news = F.concat(F.lit("<urlset><url><loc>"), link, F.lit("</loc><news:news><news:title>"), strict(title), F.lit("</news:title></news:news></url></urlset>"))
    body = F.when(kind == 0, rss).when(kind == 1, atom).when(kind == 2, news).otherwise(F.replace(rss, F.lit("</channel></rss>"), F.lit("")))
    docs = p.select(F.col("page_id").alias("id"), (F.col("page_id") % 9).alias("publisher_id"), F.lit(1).alias("country_id"), F.when(kind == 2, "sitemap-news").otherwise("rss").alias("feed_type"), body.alias("body"))
    rows = ingest.article_rows(ingest.items_of(feed_items(docs)), F.lit("2024-01-01").cast("timestamp"))
    return rows.select("feed_id", "headline", "original_url", "category", "dedup_hash")


def _submitted(s, d):
    """Submitted feeds and their homepages, some of which announce a feed."""
    p = read(s, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("https://site"), "page_id", F.lit(".example.com/")).alias("homepage_url"))
    subs = p.withColumn("feed_url", F.concat("homepage_url", F.lit("given")))
    link = F.lit('<head><link rel="alternate" type="application/rss+xml" href="/announced"></head>')
    return subs, subs.select(F.col("homepage_url").alias("url"), F.when(F.col("id") % 4 == 1, link).otherwise("<head></head>").alias("body"))


_PLACES = ", ".join(f"({stage}, {i}, '{path}', '{kind}')" for stage, kind, paths in ((2, "rss", urls.FEED_PATHS), (3, "sitemap-news", urls.SITEMAP_PATHS)) for i, path in enumerate(paths))


@_query(
    f"""SELECT page_id AS id, stage, place, 'https://site' || page_id || '.example.com' || path AS url, kind
FROM pages, (VALUES (0, 0, '/given', 'rss'), (1, 0, '/announced', 'rss'), {_PLACES}) v(stage, place, path, kind) WHERE stage <> 1 OR page_id % 4 = 1"""
)
def feed_candidates(s, d):
    return verification.candidates(*_submitted(s, d))


@_query(
    """SELECT page_id AS id, k < 3 AS verified, CASE WHEN k < 3 THEN 'rss' END AS feed_type,
  CASE WHEN k < 3 THEN 'https://site' || page_id || '.example.com/' || ['given', 'announced', 'rss.xml'][k + 1] END AS resolved_url,
  ['Feed has 1 items', 'Feed has 1 items (announced by the homepage)', 'Feed has 1 items (found on the site)',
   'Feed could not be fetched; neither the homepage''s announcements nor the usual places had a feed'][k + 1] AS detail
FROM (SELECT page_id, page_id % 4 AS k FROM pages)"""
)
def verification_chain(s, d):
    """Submitted feeds of which some work directly, some are announced, found, or not found at all."""
    subs, pages = _submitted(s, d)
    place = F.element_at(F.array(*map(F.lit, ["given", "announced", "rss.xml", "none"])), (F.col("id") % 4 + 1).cast("int"))
    feed = F.lit("<rss><channel><item><title>News</title><link>https://example.com/1</link></item></channel></rss>")
    documents = subs.select(F.concat("homepage_url", place).alias("url"), feed.alias("body"), F.lit(None).cast("string").alias("error"))
    return verification.verified(verification.candidates(subs, pages), documents)


# -- requests, listings, and what disagrees ----------------------------------


@_query(
    """WITH b AS (SELECT c_custkey AS id, c_custkey % 50 <> 0 AS given, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE '' END AS name, CASE WHEN c_custkey % 11 = 0 THEN 'nowhere' ELSE 'https://a.org/' || c_custkey END AS home,
  c_custkey % 13 <> 0 AS fed, CASE WHEN c_custkey % 17 = 0 THEN 'zz' ELSE 'nation_' || c_nationkey END AS iso, c_nationkey FROM customer),
m AS (SELECT *, CASE WHEN NOT given THEN 'name, homepage_url, feed_url, country_iso, language' ELSE concat_ws(', ', CASE WHEN name = '' THEN 'name' END, CASE WHEN NOT fed THEN 'feed_url' END) END AS missing FROM b)
SELECT id, CASE WHEN given AND iso <> 'zz' THEN c_nationkey END AS country_id,
  CASE WHEN missing <> '' THEN 'missing: ' || missing WHEN home = 'nowhere' THEN 'not a URL' WHEN iso = 'zz' THEN 'unknown country' END AS error FROM m"""
)
def submission_requests(s, d):
    """Bodies of requests: some are missing, some lack a field or name what isn't there."""
    k = F.col("c_custkey")
    body = F.to_json(
        F.struct(
            F.when(k % 7 != 0, F.col("c_name")).otherwise("").alias("name"), F.when(k % 11 == 0, "nowhere").otherwise(F.concat(F.lit("https://a.org/"), k)).alias("homepage_url"), F.when(k % 13 != 0, "https://a.org/feed").alias("feed_url"),
            F.when(k % 17 == 0, "zz").otherwise(F.concat(F.lit("nation_"), "c_nationkey")).alias("country_iso"), F.lit("en").alias("language"),
        )
    )
    bodies = read(s, d, "customer").select(k.alias("id"), F.when(k % 50 != 0, body).alias("body"))
    return moderation.validated(moderation.requests(bodies), _countries(s, d)).select("id", "country_id", "error")


_LINES = ["a", "r", "r", "a note", "s", " R ", ""]


@_query(
    "WITH RECURSIVE l AS (SELECT n_nationkey AS n, ["
    + ", ".join(f"'{x}'" for x in _LINES)
    + """][n_nationkey % 7 + 1] AS t FROM nation),
f AS (SELECT n, t, false AS is_note FROM l WHERE n = 0 UNION ALL SELECT l.n, l.t, NOT f.is_note AND lower(trim(f.t)) = 'r' FROM f JOIN l ON l.n = f.n + 1),
a AS (SELECT *, lead(t) OVER (ORDER BY n) AS following FROM f),
d AS (SELECT *, row_number() OVER (ORDER BY n) AS place FROM a WHERE NOT is_note)
SELECT CAST(place - 1 AS INTEGER) AS id, CASE lower(trim(t)) WHEN 'a' THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN lower(trim(t)) = 'r' THEN nullif(following, '') END AS note FROM d WHERE lower(trim(t)) IN ('a', 'r')"""
)
def moderator_decisions(s, d):
    """One moderator's lines, dealt to a queue."""
    n = read(s, d, "nation").select(F.col("n_nationkey").alias("id"))
    line = F.element_at(F.array(*map(F.lit, _LINES)), (F.col("id") % 7 + 1).cast("int"))
    return moderation.decisions(n.select("id", (F.col("id") + 1).alias("place")), n.select(F.col("id").alias("line_no"), line.alias("text")))


def _job_documents(s, d):
    """A JSON listing of one job for each event."""
    e = read(s, d, "events")
    owners = F.when(F.col("event_type") != "click", F.array(F.struct(F.concat(F.lit("worker"), (F.col("user_id") % 3)).alias("name"))))
    meta = F.struct(F.concat_ws("-", "event_type", "event_id").alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creationTimestamp"), owners.alias("ownerReferences"))
    job = F.struct(meta.alias("metadata"), F.struct(F.when(F.col("event_type") == "purchase", 1).alias("succeeded")).alias("status"))
    return e.select(F.to_json(F.struct(F.array(job).alias("items"))).alias("body"))


@_query(
    "SELECT event_type || '-' || event_id AS name, epoch_us(ts) // 1000000 AS created, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS succeeded, CASE WHEN event_type <> 'click' THEN 'worker' || user_id % 3 ELSE '' END AS owners FROM events"
)
def job_listing(s, d):
    return health.jobs(_job_documents(s, d)).select("name", F.unix_seconds("created").alias("created"), "succeeded", F.array_join("owners", ",").alias("owners"))


@_query("SELECT event_type || '-' || event_id AS name FROM events WHERE event_type = 'purchase'")
def jobs_by_prefix(s, d):
    return health.jobs_named(health.jobs(_job_documents(s, d)), "purchase-").select("name")


@_query("SELECT user_id AS pod, event_id AS container, CASE WHEN event_type = 'error' THEN 'CrashLoopBackOff' END AS reason FROM events WHERE event_type <> 'view'")
def container_listing(s, d):
    """A JSON listing of one pod for each event; some pods have no container."""
    reason = F.struct(F.struct(F.when(F.col("event_type") == "error", health.CRASH).alias("reason")).alias("waiting"))
    states = F.when(F.col("event_type") != "view", F.array(F.struct(F.col("event_id").cast("string").alias("name"), reason.alias("state"))))
    pod = F.struct(F.struct(F.col("user_id").cast("string").alias("name")).alias("metadata"), F.struct(states.alias("containerStatuses")).alias("status"))
    docs = read(s, d, "events").select(F.to_json(F.struct(F.array(pod).alias("items"))).alias("body"))
    return health.containers(docs).select(F.col("pod").cast("bigint").alias("pod"), F.col("container").cast("bigint").alias("container"), "reason")


@_query("SELECT o_orderkey, (c_nationkey + 1) % 25 AS country_id, c_nationkey AS expected FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0")
def dq_country(s, d):
    """Articles whose country is not their publisher's."""
    moved = F.when(F.col("id") % 10 == 0, (F.col("country_id") + 1) % 25).otherwise(F.col("country_id"))
    return quality.disagreeing(_articles(s, d).withColumn("country_id", moved), "publisher_id", "country_id", _publishers(s, d)).select(F.col("id").alias("o_orderkey"), "country_id", "expected")


@_query(f"SELECT page_id, o IS NULL OR o IN ('thther.example.org', 'm.ththth.example.net') AS allowed FROM (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN {_HOST} END AS o FROM pages)")
def request_origins(s, d):
    origin = F.when(F.col("page_id") % 5 != 0, text.host(F.col("url")))
    return read(s, d, "pages").select("page_id", read_api.allowed_origin(origin, ["thther.example.org", "m.ththth.example.net"]).alias("allowed"))


@_query(f"SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'kept' END, {_HOST}) AS domain FROM pages")
def domain_backfill(s, d):
    rows = read(s, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, "kept").alias("domain"))
    return upsert.backfill(rows, "domain", text.host(F.col("url"))).drop("url")
