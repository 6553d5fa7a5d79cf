"""Is a submitted feed one? The address itself, what its homepage announces, or the usual places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled
from ..functions.urls import FEED_PATHS, SITEMAP_PATHS, absolute, announced_links
from ..sources.feeds import rss_items, sitemap_items

DIRECT, ANNOUNCED, COMMON, SITEMAP = range(4)


def candidates(submissions: DataFrame, homepages: DataFrame) -> DataFrame:
    """(id, stage, place, url, kind) in the order in which they are tried. homepages: url, body."""
    s = submissions.select("id", "feed_url", "homepage_url")
    given = lambda stage, kind: [F.lit(stage).alias("stage"), "place", "homepage_url", "path", F.lit(kind).alias("kind")]
    links = s.join(homepages.select(F.col("url").alias("homepage_url"), announced_links(F.col("body")).alias("links")), "homepage_url")
    announced = links.select("id", "homepage_url", F.posexplode("links").alias("place", "path")).select("id", *given(ANNOUNCED, "rss"))

    def guesses(paths: list[str], stage: int, kind: str) -> DataFrame:
        return s.select("id", "homepage_url", F.posexplode(F.array(*map(F.lit, paths))).alias("place", "path")).select("id", *given(stage, kind))

    seen = announced.unionAll(guesses(FEED_PATHS, COMMON, "rss")).unionAll(guesses(SITEMAP_PATHS, SITEMAP, "sitemap-news"))
    direct = s.select("id", F.lit(DIRECT).alias("stage"), F.lit(0).alias("place"), F.col("feed_url").alias("url"), F.lit("rss").alias("kind"))
    all_of_them = direct.unionAll(seen.select("id", "stage", "place", absolute("homepage_url", "path").alias("url"), "kind"))
    return all_of_them.where(F.col("url").isNotNull())


def _is_feed(items: Column) -> Column:
    """A feed has items, and the first has a title and an address."""
    first = F.get(items, F.lit(0))
    return F.coalesce((F.size(items) > 0) & filled(first["title"]).isNotNull() & filled(first["link"]).isNotNull(), F.lit(False))


def verified(tried: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, verified, feed_type, resolved_url, detail): the first candidate that is a feed.

    documents: url, body, error of what was fetched. Where none is a feed, detail tells of the direct attempt.
    """
    fetched = tried.join(documents.select("url", "body", "error"), "url", "left")
    rss = rss_items(fetched.where("kind = 'rss'"))
    both = rss.unionByName(sitemap_items(fetched.where("kind = 'sitemap-news'")))
    ok = _is_feed(F.col("items"))
    n = F.size("items").cast("string")
    said = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("could not be fetched: "), F.col("error")))
        .when(F.col("body").isNull(), "could not be fetched")
        .when(F.col("items").isNull(), "is not well-formed")
        .when(F.size("items") == 0, "has no items")
        .when(~ok, "has a first item without title or link")
        .otherwise(F.concat(F.lit("has "), n, F.lit(" items")))
    )
    note = F.when(F.col("stage") == ANNOUNCED, " (announced by the homepage)").when(F.col("stage") > ANNOUNCED, " (found on the site)").otherwise("")
    rows = both.select("id", "stage", "place", "url", "kind", ok.alias("ok"), F.concat(F.lit("Feed "), said, note).alias("detail"))
    order = F.struct("stage", "place")
    found = rows.groupBy("id").agg(
        F.min_by(F.when(F.col("ok"), F.struct("kind", "url", "detail")), F.when(F.col("ok"), order)).alias("hit"),
        F.min_by("detail", order).alias("direct"),
    )
    failed = F.concat("direct", F.lit("; neither the homepage's announcements nor the usual places had a feed"))
    return found.select("id", F.col("hit").isNotNull().alias("verified"), F.col("hit.kind").alias("feed_type"), F.col("hit.url").alias("resolved_url"), F.coalesce("hit.detail", failed).alias("detail"))
