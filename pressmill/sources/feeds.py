"""Feeds: documents that were fetched, parsed to items; and the connector that fetches them."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import escape_ampersands, filled
from .pool import completed

AGENT = "pressmill/0.1 (feed reader)"
#: Seconds that an answer may take.
TIMEOUT = 15
ANSWER = "url string, status int, body string, etag string, last_modified string, error string"

_TEXT = "struct<_VALUE:string>"
_CATEGORY = "array<struct<_VALUE:string,_domain:string,_term:string>>"
_RSS_ITEM = f"array<struct<title:string,link:string,pubDate:string,`dc:date`:string,description:string,`content:encoded`:string,enclosure:struct<_url:string>,`dc:creator`:string,author:string,category:{_CATEGORY}>>"
_RSS = f"struct<channel:struct<item:{_RSS_ITEM}>,_corrupt_record:string>"
_ATOM = f"struct<entry:array<struct<title:{_TEXT},link:array<struct<_href:string,_rel:string>>,published:string,updated:string,summary:{_TEXT},content:{_TEXT},author:struct<name:string>,category:{_CATEGORY}>>,_corrupt_record:string>"
_SITEMAP = "struct<url:array<struct<loc:string,`news:news`:struct<`news:title`:string,`news:publication_date`:string>>>,_corrupt_record:string>"


def _xml(text: Column, schema: str) -> Column:
    # attributes are kept as _name, the text of an element with attributes as _VALUE
    return F.from_xml(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "attributePrefix": "_", "valueTag": "_VALUE"})


def _bare(html: Column) -> Column:
    """Text without markup."""
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def _quoted(text: Column) -> Column:
    return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":|\}$', ""))


def rss_items(documents: DataFrame, body: str = "body") -> DataFrame:
    """documents with items (null: not well-formed) from RSS or Atom; bare ampersands are repaired first."""
    repaired = escape_ampersands(F.col(body))
    atom = repaired.rlike(r"(?s)^\s*(<\?xml[^>]*>)?\s*(<!--.*?-->\s*)*<feed\b")
    parsed = documents.withColumn("_rss", F.when(~atom, _xml(repaired, _RSS))).withColumn("_atom", F.when(atom, _xml(repaired, _ATOM)))

    def category(c: Column) -> Column:
        return F.transform(c, lambda x: F.struct(F.coalesce(x["_VALUE"], x["_term"]).alias("_VALUE"), x["_domain"].alias("_domain")))

    def from_rss(i: Column) -> Column:
        return F.struct(
            i["title"].alias("title"),
            i["link"].alias("link"),
            i["dc:date"].alias("isoDate"),
            i["pubDate"].alias("pubDate"),
            _bare(filled(i["content:encoded"], i["description"])).alias("contentSnippet"),
            F.lit(None).cast("string").alias("summary"),
            F.struct(i["enclosure"]["_url"].alias("url")).alias("enclosure"),
            _quoted(i["dc:creator"]).alias("creator"),
            _quoted(i["author"]).alias("author"),
            category(i["category"]).alias("categories"),
        )

    def from_atom(i: Column) -> Column:
        links = F.filter(i["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        return F.struct(
            i["title"]["_VALUE"].alias("title"),
            F.try_element_at(links, F.lit(1))["_href"].alias("link"),
            filled(i["published"], i["updated"]).alias("isoDate"),
            i["updated"].alias("pubDate"),
            _bare(i["content"]["_VALUE"]).alias("contentSnippet"),
            i["summary"]["_VALUE"].alias("summary"),
            F.struct(F.lit(None).cast("string").alias("url")).alias("enclosure"),
            F.lit(None).cast("string").alias("creator"),
            _quoted(i["author"]["name"]).alias("author"),
            category(i["category"]).alias("categories"),
        )

    none = F.lit(None)
    items = (
        F.when(atom & F.col("_atom._corrupt_record").isNull(), F.coalesce(F.transform("_atom.entry", from_atom), F.array()))
        .when(~atom & F.col("_rss._corrupt_record").isNull(), F.coalesce(F.transform("_rss.channel.item", from_rss), F.array()))
        .otherwise(none)
    )
    return parsed.withColumn("items", items).drop("_rss", "_atom")


def sitemap_items(documents: DataFrame, body: str = "body") -> DataFrame:
    """documents with items (null: not well-formed) from news sitemaps: entries with a news title and an address."""
    parsed = documents.withColumn("_map", _xml(F.col(body), _SITEMAP))
    usable = F.filter("_map.url", lambda u: filled(u["news:news"]["news:title"]).isNotNull() & filled(u["loc"]).isNotNull())
    null = lambda kind: F.lit(None).cast(kind)

    def item(u: Column) -> Column:
        date = filled(u["news:news"]["news:publication_date"])
        return F.struct(
            u["news:news"]["news:title"].alias("title"),
            u["loc"].alias("link"),
            date.alias("isoDate"),
            date.alias("pubDate"),
            null("string").alias("contentSnippet"),
            null("string").alias("summary"),
            F.struct(null("string").alias("url")).alias("enclosure"),
            null("string").alias("creator"),
            null("string").alias("author"),
            null("array<struct<_VALUE:string,_domain:string>>").alias("categories"),
        )

    items = F.when(F.col("_map._corrupt_record").isNull(), F.coalesce(F.transform(usable, item), F.array()))
    return parsed.withColumn("items", items).drop("_map")


def feed_items(documents: DataFrame, body: str = "body", kind: str = "feed_type") -> DataFrame:
    """documents with items by their feed type: news sitemaps as such, all others as RSS or Atom."""
    news = F.col(kind) == "sitemap-news"
    rss = rss_items(documents.where(~F.coalesce(news, F.lit(False))), body)
    return rss.unionByName(sitemap_items(documents.where(news), body))


@dataclass
class _Feed(InputPartition):
    rows: list
    slots: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        import json

        self.feeds = json.loads(options["feeds"])  # [{url, etag, last_modified}]
        self.slots, self.tasks = int(options.get("slots", "20")), int(options.get("tasks", "2"))

    def partitions(self):
        tasks = max(1, min(self.tasks, self.slots, len(self.feeds)))
        return [_Feed(self.feeds[i::tasks], share) for i, share in enumerate(shares(self.slots, tasks))]

    def read(self, partition) -> Iterator[tuple]:
        yield from (x for x in answers(partition.rows, partition.slots) if x)


def shares(slots: int, tasks: int) -> list[int]:
    """Slots of each task; together no more than there are."""
    return [slots // tasks + (i < slots % tasks) for i in range(tasks)]


def answers(feeds, slots: int, seconds: float | None = None, until: float | None = None) -> Iterator[tuple | None]:
    """What fetch gives for each of the feeds, in order of completion, `slots` at a time; None in a lull."""
    seconds = TIMEOUT if seconds is None else seconds
    ask = lambda f: fetch(f["url"], f.get("etag"), f.get("last_modified"), seconds)
    for found in completed(feeds, ask, slots, seconds + 1, until):
        if found is None:
            yield None
        else:
            feed, answer, error = found
            yield answer if error is None else (feed["url"], None, None, None, None, str(error) or type(error).__name__)


def fetch(url: str, etag: str | None = None, last_modified: str | None = None, seconds: float = TIMEOUT) -> tuple:
    """(url, status, body, etag, last_modified, error): one conditional request; errors are rows, too.

    seconds is for the whole answer: one that comes in drops is given up, too.
    """
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    headers = {"User-Agent": AGENT} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": last_modified} if last_modified else {})
    end = time.monotonic() + seconds
    try:
        with urlopen(Request(url, headers=headers), timeout=seconds) as got:
            parts = []
            while part := got.read1(1 << 16):
                parts.append(part)
                if time.monotonic() > end:
                    raise TimeoutError(f"no whole answer within {seconds:g} seconds")
            body = b"".join(parts).decode(got.headers.get_content_charset() or "utf-8", "replace")
            return url, getattr(got, "status", None) or 200, body, got.headers.get("ETag"), got.headers.get("Last-Modified"), None
    except HTTPError as e:
        return (url, 304, None, etag, last_modified, None) if e.code == 304 else (url, e.code, None, None, None, f"HTTP {e.code}")
    except Exception as e:
        return url, None, None, None, None, str(e) or type(e).__name__


class FeedSource(DataSource):
    """spark.read.format("feeds"): one row for each feed of the option `feeds` (JSON), fetched by `slots` slots in `tasks` tasks.

    As a stream (spark.readStream.format("feeds")) see feed_stream.
    """

    @classmethod
    def name(cls):
        return "feeds"

    def schema(self):
        return ANSWER

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):  # noqa: N802
        from .feed_stream import FeedStream

        return FeedStream(self.options)
