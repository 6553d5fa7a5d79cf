from pyspark.sql import functions as F

from pressmill import schemas
from pressmill.operators import health
from pressmill.plans import read_api
from pressmill.plans.cycle import poll_once
from pressmill.sources import tables as store

from .test_feeds import MAP, RSS


def test_poll_once(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS.replace("06 May 2024", "30 May 2024"))
    (tmp_path / "m.xml").write_text(MAP.replace("2024-05-06", "2024-06-01"))
    (tmp_path / "bad.xml").write_text("<rss>")
    url = lambda n: f"file://{tmp_path}/{n}"
    rows = [(1, 1, url("a.xml"), "rss"), (2, 1, url("a.xml"), "rss"), (3, 2, url("m.xml"), "sitemap-news"), (4, 2, url("bad.xml"), "rss"), (5, 2, url("none.xml"), "rss"), (6, 3, url("a.xml"), "rss")]
    feeds = spark.createDataFrame(rows, "id int, publisher_id int, feed_url string, feed_type string")
    for f in schemas.feeds():
        if f.name not in feeds.columns:
            feeds = feeds.withColumn(f.name, F.lit(None).cast(f.dataType))
    publishers = spark.createDataFrame([(1, 1, "a", "active"), (2, 1, "b", "active"), (3, 1, "c", "pending")], "id int, country_id int, name string, feed_status string")
    now = F.lit("2024-06-02").cast("timestamp")
    done = poll_once(spark, feeds, publishers, spark.createDataFrame([], schemas.articles()), str(tmp_path / "landed"), now, 3)
    got = sorted((r.publisher_id, r.headline, r.feed_id) for r in done.articles.collect())
    assert got == [(1, "One & two", 1), (2, "T", 3), (2, "V", 3)]
    assert sorted(r.id for r in done.articles.collect()) == [1, 2, 3]
    status = {r.id: r.last_status for r in done.feeds.collect()}
    assert [status[i] for i in (1, 2, 3)] == ["ok"] * 3 and status[6] is None
    assert status[4] == "error: not well-formed" and status[5].startswith("error: ")
    assert tuple(done.summary.head()) == (5, 3, 3)
    again = poll_once(spark, feeds, publishers, done.articles, str(tmp_path / "again"), now, 3)
    assert again.articles.count() == 0 and tuple(again.summary.head()) == (5, 3, 0)


def test_service_checks(spark):
    rows = [("countries", 190, None), ("replicas", 0, None), ("certificate_days", 14, None), ("crashing", None, None), ("database_running", 1, True)]
    got = {r.name: r.state for r in health.service_checks(spark.createDataFrame(rows, "name string, value int, skip boolean")).collect()}
    assert got == {"countries": "PASS", "replicas": "FAIL", "certificate_days": "PASS", "crashing": "FAIL", "database_running": "SKIPPED"}


def test_map_and_choice(spark):
    countries = spark.createDataFrame([("CI", "a", 1.0, 2.0), ("NG", "b", None, 2.0)], "iso_code string, name string, lat double, lng double")
    assert [(r.iso_code, r.selected) for r in read_api.map_points(countries, "CI").collect()] == [("CI", True)]
    asked = spark.createDataFrame([(1, "zz", "ng", "CI"), (2, None, None, None), (3, "ci", "ng", None)], "client int, saved string, by_ip string, by_locale string")
    assert {r.client: r.country for r in read_api.choose_country(asked, countries).collect()} == {1: "NG", 2: None, 3: "CI"}


def test_snapshots_are_listed(spark, tmp_path):
    for n in ("2024-01-01_a", "2024-02-01_b"):
        (tmp_path / n).mkdir()
    assert [r.name for r in store.snapshots(spark, str(tmp_path)).collect()] == ["2024-02-01_b", "2024-01-01_a"]
    assert store.latest_snapshot(spark, str(tmp_path)).head().name == "2024-02-01_b"
