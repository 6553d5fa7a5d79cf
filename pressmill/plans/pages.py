"""Deep pages: an index of articles in the order of their pages, with counts, so that an offset is looked up and not walked to.

Articles lie in ranges of the order (country, the latest first, those without a date
last, ties by id), each a folder of about `RANGE_BYTES` (where there are few articles, less, down to
`LEAST_BYTES`, for all cores to sort). Beside them is a table of how
many articles of each country and category each range has. A page adds the counts up to
where its offset falls and reads the one or two ranges it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import dropped, written
from .read_api import page_limit, page_offset

RANGE_BYTES, LEAST_BYTES = 32 << 20, 1 << 20


def _latest() -> list:
    return [F.desc_nulls_last("published_at"), F.col("id")]


def build(articles: DataFrame, path: str, ranges: int | None = None) -> None:
    """Writes the index of articles (id, country_id, category, published_at, ...) to a folder."""
    # what a plan takes a join's size for is the product of its sides' sizes; files have a size, and are read twice here
    articles = written(articles, "articles")
    if ranges is None:
        size = int(str(articles._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        usual = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(1, min(usual, -(-size // LEAST_BYTES)), -(-size // RANGE_BYTES))
    order = [F.col("country_id"), *_latest()]
    dealt = articles.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    dealt.sortWithinPartitions("range", *order).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    dropped(articles)
    rows = articles.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    rows.groupBy("country_id", "category", "range").agg(F.count("*").alias("n")).repartition("country_id").sortWithinPartitions("country_id", "range").write.mode("overwrite").parquet(f"{path}/counts")


def touched(spark: SparkSession, path: str, country_id: int, category: str | None, offset: int, limit: int) -> list[tuple[int, int]]:
    """(range, articles of earlier ranges) of the ranges that hold a page, in order: no more than the page has articles."""
    own = spark.read.parquet(f"{path}/counts").where(F.col("country_id") == country_id)
    if category:
        own = own.where(F.col("category") == category)
    each = own.groupBy("range").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one country's ranges
    found = each.withColumn("before", before).where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    return [(r.range, r.before) for r in found.orderBy("range").collect()]


def page(spark: SparkSession, path: str, country_id: int, category: str | None = None, limit=None, offset=None) -> DataFrame:
    """A page of a country's articles, as read_api.articles orders them."""
    limit, offset = page_limit(limit), page_offset(offset)
    found = touched(spark, path, country_id, category, offset, limit)
    rows = spark.read.option("basePath", f"{path}/rows")
    if not found:
        return rows.parquet(f"{path}/rows").drop("range").limit(0)
    own = rows.parquet(*[f"{path}/rows/range={r}" for r, _ in found]).drop("range").where(F.col("country_id") == country_id)
    if category:
        own = own.where(F.col("category") == category)
    return own.orderBy(*_latest()).offset(offset - found[0][1]).limit(limit)
