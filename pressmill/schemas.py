"""Schemas of the five tables and of the records that pass between the steps."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in (part.strip().split(" ", 1) for part in spec.split(";"))])


def countries() -> T.StructType:
    return _struct("id int; iso_code string; name string; region string; capital string; population bigint; languages array<string>; timezone string; flag_url string; lat double; lng double; created_at timestamp")


def publishers() -> T.StructType:
    return _struct("id int; country_id int; name string; homepage_url string; logo_url string; feed_status string; language string; created_at timestamp; domain string")


def feeds() -> T.StructType:
    return _struct("id int; publisher_id int; feed_url string; feed_type string; last_fetched_at timestamp; last_status string; etag string; last_modified string; created_at timestamp")


def articles() -> T.StructType:
    return _struct(
        "id bigint; feed_id int; publisher_id int; country_id int; headline string; summary string; image_url string; original_url string; author string; category string; published_at timestamp; fetched_at timestamp; dedup_hash string"
    )


def submissions() -> T.StructType:
    return _struct(
        "id int; name string; homepage_url string; feed_url string; country_id int; language string; contact_email string; status string; feed_verified boolean; verification_detail string; reviewer_note string; submitted_at timestamp; reviewed_at timestamp; feed_type string"
    )


#: An item of a parsed feed. creator and author hold JSON: a string, or something else that is no name.
ITEM = "struct<title:string, link:string, isoDate:string, pubDate:string, contentSnippet:string, summary:string, enclosure:struct<url:string>, creator:string, author:string, categories:array<struct<_VALUE:string,_domain:string>>>"

NOT_NULL = {
    "countries": ["iso_code", "name", "region", "languages"],
    "publishers": ["country_id", "name", "homepage_url", "feed_status", "language", "domain"],
    "feeds": ["publisher_id", "feed_url", "feed_type"],
    "articles": ["feed_id", "publisher_id", "country_id", "headline", "original_url", "category", "dedup_hash"],
    "submissions": ["name", "homepage_url", "feed_url", "country_id", "language", "status", "feed_verified", "feed_type"],
}
UNIQUE = {
    "countries": [["iso_code"]],
    "publishers": [["country_id", "name"], ["country_id", "domain"]],
    "feeds": [["feed_url"]],
    "articles": [["dedup_hash"]],
}
ALLOWED = {
    "publishers": {"feed_status": ["active", "unavailable", "pending"]},
    "feeds": {"feed_type": ["rss", "atom", "sitemap-news"]},
    "submissions": {"status": ["pending", "approved", "rejected"], "feed_type": ["rss", "sitemap-news"]},
}
FOREIGN = [
    ("publishers", "country_id", "countries"),
    ("feeds", "publisher_id", "publishers"),
    ("articles", "feed_id", "feeds"),
    ("articles", "publisher_id", "publishers"),
    ("articles", "country_id", "countries"),
    ("submissions", "country_id", "countries"),
]
