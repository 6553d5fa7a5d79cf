import threading
import time

import pytest
from pyspark.sql import functions as F

from pressmill import schemas
from pressmill.plans import cycle
from pressmill.streaming import lease as leases
from pressmill.streaming.poll import poll

from .test_streaming import feed, land


def rows(spark, *numbers):
    return spark.createDataFrame([(i,) for i in numbers], "n int").coalesce(2)


def test_one_of_many_gets_it(spark, tmp_path):
    table, got, lock = f"{tmp_path}/t", [], threading.Lock()

    def go():
        try:
            mine = leases.acquire(spark, table)
            with lock:
                got.append(mine.number)
        except leases.Busy:
            pass

    threads = [threading.Thread(target=go) for _ in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [1]
    with pytest.raises(leases.Busy):
        leases.acquire(spark, table)


def test_released_waited_for_and_expired(spark, tmp_path):
    table = f"{tmp_path}/t"
    first = leases.acquire(spark, table, 30)
    threading.Timer(0.5, first.release).start()
    second = leases.acquire(spark, table, 1, wait=20)
    assert second.number == 2 and not second.inherited
    second.check()
    third = leases.acquire(spark, table, 30, wait=20)  # the second was never released: its holder is dead
    assert third.number == 3 and third.inherited
    with pytest.raises(leases.Lost):
        second.check()
    third.check()
    third.release()
    with leases.held(spark, table) as fourth:
        assert fourth.number == 4 and not fourth.inherited
    with pytest.raises(ValueError), leases.held(spark, table, 0.2):
        raise ValueError
    assert leases.acquire(spark, table, wait=5).inherited
    assert len(leases.Files(spark, table + ".leases").names()) < 6  # old leases go


def test_a_sleeper_adds_nothing(spark, tmp_path):
    table = f"{tmp_path}/t"
    slow = leases.acquire(spark, table, 10)
    slow.append(rows(spark, 1, 2))
    time.sleep(max(0, slow.until - time.time()) + 0.1)
    with pytest.raises(leases.Lost):
        slow.append(rows(spark, 3))
    after = leases.acquire(spark, table, 60)
    after.append(rows(spark, 4))
    after.append(rows(spark, 5))
    with pytest.raises(leases.Lost):  # even where its own clock goes wrong
        slow.until = time.time() + 99
        slow.append(rows(spark, 6))
    assert sorted(r.n for r in spark.read.parquet(table).collect()) == [1, 2, 4, 5]


def test_two_polls_at_once_store_each_headline_once(spark, tmp_path):
    landing, table = tmp_path / "in", str(tmp_path / "table")
    land(landing, "1.json", *[(i, i % 3, feed(*(f"H{k}" for k in range(i, i + 6)))) for i in range(8)])
    since = F.lit("2024-01-01").cast("timestamp")
    both = [poll(spark, str(landing), table, str(tmp_path / f"cp{k}"), since) for k in range(2)]
    for q in both:
        assert q.awaitTermination(200)
        assert q.exception() is None
    got = spark.read.parquet(table).select("id", "publisher_id", "headline").collect()
    want = {(i % 3, f"H{k}") for i in range(8) for k in range(i, i + 6)}
    assert len(got) == len(want) == len({r.id for r in got}) and {(r.publisher_id, r.headline) for r in got} == want
    assert sorted(r.id for r in got) == list(range(1, len(want) + 1))


def test_a_poll_is_skipped_while_another_runs(spark, tmp_path):
    (tmp_path / "a.xml").write_text(feed("One", "Two"))
    feeds = spark.createDataFrame([(1, 1, f"file://{tmp_path}/a.xml", "rss")], "id int, publisher_id int, feed_url string, feed_type string")
    for f in schemas.feeds():
        if f.name not in feeds.columns:
            feeds = feeds.withColumn(f.name, F.lit(None).cast(f.dataType))
    publishers = spark.createDataFrame([(1, 1, "a", "active")], "id int, country_id int, name string, feed_status string")
    table, now = str(tmp_path / "table"), F.lit("2024-06-02").cast("timestamp")
    go = lambda n, **more: cycle.poll_alone(spark, feeds, publishers, table, str(tmp_path / n), now, 3, **more)
    running = leases.acquire(spark, table, 60)
    assert go("skipped") is None and not (tmp_path / "skipped").exists()
    running.release()
    assert go("first") and go("second")
    assert sorted(r.headline for r in spark.read.parquet(table).collect()) == ["One", "Two"]
    with pytest.raises(leases.Lost):
        go("late", seconds=0.01)
