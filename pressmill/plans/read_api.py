"""The read queries: countries, publishers and articles, with optional filters, order and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTRY = ["iso_code", "name", "region", "capital", "population", "languages", "timezone", "flag_url", "lat", "lng"]
PUBLISHER = ["id", "name", "homepage_url", "logo_url", "feed_status", "language"]
USUAL_PAGE, LARGEST_PAGE = 30, 100


class NotFound(LookupError):
    """No row has the key that was asked for."""


def list_countries(countries: DataFrame) -> DataFrame:
    return countries.select(COUNTRY).orderBy("name")


def country(countries: DataFrame, iso: str) -> DataFrame:
    return countries.where(F.col("iso_code") == F.upper(F.lit(iso))).select(COUNTRY)


def found(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise NotFound
    return rows


def of_country(rows: DataFrame, countries: DataFrame, iso: str, key: str = "country_id") -> DataFrame:
    """Rows of a country; none for a country that is unknown."""
    one = countries.where(F.col("iso_code") == F.upper(F.lit(iso))).select(F.col("id").alias(key))
    return rows.join(F.broadcast(one), key, "left_semi")  # iso codes are unique: a row at most


def publishers(rows: DataFrame, countries: DataFrame, iso: str) -> DataFrame:
    return of_country(rows, countries, iso).select(PUBLISHER).orderBy("name")


def page(rows: DataFrame, limit: int | str | None, offset: int | str | None) -> DataFrame:
    return rows.offset(page_offset(offset)).limit(page_limit(limit))


def _leading(text) -> int | None:
    import re

    m = re.match(r"\s*([+-]?\d+)", str(text)) if text is not None else None
    return int(m[1]) if m else None


def page_limit(text) -> int:
    """30 for what is absent, zero or no number, 100 at most; negative limits are refused by Spark."""
    return min(_leading(text) or USUAL_PAGE, LARGEST_PAGE)


def page_offset(text) -> int:
    return _leading(text) or 0


def articles(rows: DataFrame, publishers: DataFrame, countries: DataFrame, iso: str, category: str | None = None, limit=None, offset=None) -> DataFrame:
    """A country's articles, the latest first, those without a date last, ties by id."""
    own = of_country(rows, countries, iso)
    if category:
        own = own.where(F.col("category") == category)
    # top-k before the join: a page needs a hundred publishers at most
    top = page(own.orderBy(F.desc_nulls_last("published_at"), "id"), limit, offset)
    p = publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher_name"), F.col("homepage_url").alias("publisher_url"))
    return top.join(p, "publisher_id").orderBy(F.desc_nulls_last("published_at"), "id")


def article(rows: DataFrame, publishers: DataFrame, article_id: int) -> DataFrame:
    p = publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher_name"), F.col("homepage_url").alias("publisher_url"))
    return rows.where(F.col("id") == article_id).join(p, "publisher_id")


def poll_plan(feeds: DataFrame, publishers: DataFrame) -> DataFrame:
    """The feeds of active publishers, with what a poll needs."""
    p = publishers.where("feed_status = 'active'").select(F.col("id").alias("publisher_id"), "country_id", F.col("name").alias("publisher_name"))
    return feeds.join(p, "publisher_id").select("id", "publisher_id", "country_id", "publisher_name", "feed_url", "feed_type", "etag", "last_modified")


def map_points(countries: DataFrame, selected: str | None) -> DataFrame:
    """Points of a map: the selected country is larger and stands out."""
    chosen = F.coalesce(F.col("iso_code") == F.lit(selected), F.lit(False))
    return countries.where("lat IS NOT NULL AND lng IS NOT NULL").select("iso_code", "name", "lat", "lng", F.when(chosen, 0.8).otherwise(0.4).alias("radius"), chosen.alias("selected"))


def allowed_origin(origin, allowed: list[str]):
    """Whether a request may come from there: from nowhere, or from a listed place."""
    return origin.isNull() | F.array_contains(F.array(*map(F.lit, allowed)), origin)


def choose_country(candidates: DataFrame, countries: DataFrame) -> DataFrame:
    """candidates(client, saved, by_ip, by_locale) with country: the first that is known, else null."""
    known = countries.select("iso_code")
    out = candidates
    for c in ("saved", "by_ip", "by_locale"):
        out = out.join(F.broadcast(known.withColumnRenamed("iso_code", f"_{c}")), F.upper(c) == F.col(f"_{c}"), "left")  # a row for each country
    return out.select(*candidates.columns, F.coalesce("_saved", "_by_ip", "_by_locale").alias("country"))
