"""From fetched feeds to stored articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators.upsert import insert_ignore, new_rows, with_ids
from ..scratch import written
from ..streaming.hash_index import HashIndex

ROW = ["feed_id", "publisher_id", "country_id", "headline", "summary", "image_url", "original_url", "author", "category", "published_at", "dedup_hash"]


def article_rows(items: DataFrame, since: Column) -> DataFrame:
    """Article rows of items: feed_id, publisher_id, country_id, position, and item (schemas.ITEM).

    Items without title or address are dropped, and those from before the cutoff; others keep their
    position in the feed, for the first of equal headlines to win.
    """
    i = lambda name: F.col(f"item.{name}")
    rows = items.withColumn("published_at", dates.published_at(i("isoDate"), i("pubDate"))).where(dates.is_fresh(F.col("published_at"), since))
    rows = rows.where(text.filled(i("title")).isNotNull() & text.filled(i("link")).isNotNull())
    return rows.select(
        "feed_id",
        "publisher_id",
        "country_id",
        i("title").alias("headline"),
        text.summary(i("contentSnippet"), i("summary")).alias("summary"),
        text.filled(i("enclosure.url")).alias("image_url"),
        i("link").alias("original_url"),
        text.author(i("creator"), i("author")).alias("author"),
        text.categorize(text.category_texts(i("categories")), i("title")).alias("category"),
        "published_at",
        text.dedup_hash(F.col("publisher_id"), i("title")).alias("dedup_hash"),
        "position",
    )


def items_of(parsed: DataFrame) -> DataFrame:
    """One row for each item of parsed feeds."""
    return parsed.select(F.col("id").alias("feed_id"), "publisher_id", "country_id", F.posexplode("items").alias("position", "item"))


def new_articles(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows to append: the first of each key that isn't stored, with ids behind those that are there."""
    fresh = insert_ignore(stored, rows, ["dedup_hash"], ["feed_id", "position"])
    return with_ids(fresh, stored, ["feed_id", "position", "dedup_hash"]).select("id", *ROW)


def indexed_articles(index: HashIndex, rows: DataFrame) -> DataFrame:
    """As new_articles, but what is stored is asked of an index, and so is the largest id."""
    rows = written(rows, "rows")  # parsed once
    fresh = new_rows(rows, index.known(rows), ["dedup_hash"], ["feed_id", "position"])
    top = rows.sparkSession.createDataFrame([(index.top,)], "id bigint")
    return with_ids(fresh, top, ["feed_id", "position", "dedup_hash"]).select("id", *ROW)


def outcomes(fetched: DataFrame) -> DataFrame:
    """(id, status, etag, last_modified) of a poll: one row for each feed, failures too. items null: not well-formed."""
    status = (
        F.when(F.col("error").isNotNull(), text.error_status(F.col("error")))
        .when(F.col("status") == 304, "not_modified")
        .when(F.col("items").isNull(), text.error_status(F.lit("not well-formed")))
        .otherwise("ok")
    )
    return fetched.select("id", status.alias("status"), "etag", "last_modified")


def summary(results: DataFrame) -> DataFrame:
    """One row: feeds, ok, inserted (0 where there is none). results: ok, inserted."""
    return results.agg(F.count("*").alias("feeds"), F.count_if("ok").alias("ok"), F.coalesce(F.sum(F.coalesce("inserted", F.lit(0))), F.lit(0)).alias("inserted"))
