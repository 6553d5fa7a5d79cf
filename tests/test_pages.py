import random

import pytest
from pyspark.sql import functions as F

from pressmill.plans import pages


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for i in range(5000)]
    path = str(tmp_path_factory.mktemp("pages"))
    df = spark.createDataFrame(rows, "id int, country_id int, category string, day int").withColumn("published_at", F.timestamp_seconds(F.col("day") * 86400))
    pages.build(df.repartition(3), path, 12)
    return path, rows


def in_order(rows, country, category=None):
    own = [r for r in rows if r[1] == country and category in (None, r[2])]
    return [r[0] for r in sorted(own, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))]


@pytest.mark.parametrize(("country", "category"), [(1, None), (1, "a"), (2, "b"), (9, None), (1, "none")])
def test_pages_at_any_offset(spark, index, country, category):
    path, rows = index
    want = in_order(rows, country, category)
    for offset in (0, 29, len(want) // 2, max(0, len(want) - 10), len(want), len(want) + 500):
        got = [r.id for r in pages.page(spark, path, country, category, "25", offset).collect()]
        assert got == want[offset : offset + 25], offset


def test_a_deep_page_reads_its_own_range(spark, index):
    path, rows = index
    want = in_order(rows, 1)
    df = pages.page(spark, path, 1, limit=20, offset=len(want) - 40)
    folders = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert 1 <= len(folders) <= 2 and "rangepartitioning" not in plan and "TakeOrderedAndProject" in plan
    assert [r.id for r in df.collect()] == want[-40:-20]
    assert len(pages.touched(spark, path, 1, None, 0, 100)) <= 2


def test_ranges_follow_the_articles_themselves(spark, tmp_path):
    """A join's estimated size is the product of its sides'; there are as many ranges as its rows need."""
    many = spark.range(2000).select(F.col("id"), (F.col("id") % 5).alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("category"), F.timestamp_seconds("id").alias("published_at"))
    many.write.parquet(str(tmp_path / "articles"))
    spark.range(2000).select(F.col("id").alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("x"), (F.col("id") % 3).alias("country_id")).write.parquet(str(tmp_path / "publishers"))
    joined = spark.read.parquet(str(tmp_path / "articles")).join(spark.read.parquet(str(tmp_path / "publishers")), "p").drop("p")
    path = str(tmp_path / "pages")
    pages.build(joined, path)
    assert 1 <= len(list((tmp_path / "pages" / "rows").glob("range=*"))) <= 4
    assert [r.id for r in pages.page(spark, path, 1, limit=3, offset=200).collect()] == [1499, 1496, 1494]
