import json
import random

import pandas as pd
from pyspark.sql import functions as F

from pressmill.streaming.poll import poll
from pressmill.operators import runs
from pressmill.streaming.ratelimit import limited, log_limited


def feed(*titles):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>https://e.org/{i}</link></item>" for i, t in enumerate(titles)) + "</channel></rss>"


def land(path, name, *rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps({"id": i, "publisher_id": p, "country_id": 1, "feed_type": "rss", "body": b}) for i, p, b in rows))


def test_each_article_is_stored_once(spark, tmp_path):
    landing, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "cp")
    since = F.lit("2024-01-01").cast("timestamp")

    def run():
        poll(spark, str(landing), table, checkpoint, since).awaitTermination(120)
        return sorted((r.publisher_id, r.headline) for r in spark.read.parquet(table).collect())

    land(landing, "1.json", (1, 1, feed("One", " ONE ", "Two")), (2, 1, feed("two")), (3, 2, feed("One")), (4, 1, "<rss>"))
    assert run() == [(1, "One"), (1, "Two"), (2, "One")]
    land(landing, "2.json", (1, 1, feed("One", "Three")))
    assert run() == [(1, "One"), (1, "Three"), (1, "Two"), (2, "One")]
    assert len(run()) == 4


def test_ids_and_outcomes(spark, tmp_path):
    from pressmill import schemas
    from pressmill.streaming.poll import feeds_now

    landing, table, log, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "log"), str(tmp_path / "cp")
    since = F.lit("2024-01-01").cast("timestamp")
    landing.mkdir()

    def run(name, *rows):
        (landing / name).write_text("\n".join(json.dumps({"publisher_id": 1, "country_id": 1, "feed_type": "rss"} | r) for r in rows))
        poll(spark, str(landing), table, checkpoint, since, log=log).awaitTermination(120)

    run("1.json", {"id": 1, "body": feed("One", "Two"), "status": 200, "etag": "e1"}, {"id": 2, "body": "<rss>", "status": 200, "etag": "bad"})
    run("2.json", {"id": 1, "status": 304}, {"id": 2, "body": feed("Three"), "status": 200, "etag": "e2"}, {"id": 3, "error": "timeout"})
    stored = spark.read.parquet(table)
    assert stored.columns == schemas.articles().names and sorted((r.id, r.headline) for r in stored.collect()) == [(1, "One"), (2, "Two"), (3, "Three")]
    feeds = spark.createDataFrame([(i, None, None, "old", None) for i in range(1, 5)], "id int, last_fetched_at timestamp, last_status string, etag string, last_modified string")
    now = feeds_now(feeds, spark.read.parquet(log), F.current_timestamp())
    got = {r.id: (r.last_status, r.etag) for r in now.collect()}
    assert got == {1: ("not_modified", "e1"), 2: ("ok", "e2"), 3: ("error: timeout", "old"), 4: (None, "old")}


def test_rate_limit(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    rows = [("a", start + pd.Timedelta(milliseconds=100 * i)) for i in range(101)] + [("b", start)] + [("a", start + pd.Timedelta(seconds=61))]
    spark.createDataFrame(pd.DataFrame(rows, columns=["client", "at"])).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, at timestamp").parquet(str(tmp_path / "in"))
    query = limited(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()
    a = [r.status for r in got if r.client == "a"]
    assert a == [200] * 100 + [429, 200]
    assert [r.status for r in got if r.client == "b"] == [200]


def plain_windows(times, most, seconds):
    opened, out = None, []
    for t in sorted(times):
        if opened is None or t - opened >= seconds:
            opened, n = t, 0
        n += 1
        out.append((t, opened, n, 200 if n <= most else 429))
    return out


def test_a_log_has_the_streams_windows(spark, tmp_path, monkeypatch):
    """One client has most of the requests, and its log is cut into many blocks; some come at one instant."""
    rng = random.Random(9)
    start = pd.Timestamp("2024-01-01")
    times = {"hot": [rng.randrange(20_000) for _ in range(1500)] + [77] * 20 + [77 + 60], "b": [0, 59, 60, 60, 61, 119, 120], "c": [5], None: [1, 2, 3, 100]}
    rows = [(c, start + pd.Timedelta(seconds=t), i) for c, ts in times.items() for i, t in enumerate(ts)]
    log = spark.createDataFrame(pd.DataFrame(rows, columns=["client", "at", "n"])).withColumns({"most": F.lit(3), "seconds": F.lit(60)}).repartition(3)
    want = sorted(((c, *x) for c, ts in times.items() for x in plain_windows(ts, 3, 60)), key=str)
    second = lambda t: int((t - start.to_pydatetime()).total_seconds())
    for block in (runs.BLOCK, 64):
        monkeypatch.setattr(runs, "BLOCK", block)
        got = log_limited(log, ["n"]).collect()
        assert sorted(((r.client, second(r["at"]), second(r.opened), r.nth, r.status) for r in got), key=str) == want
    assert log_limited(log.where("false"), ["n"]).count() == 0
    log.where("client IS NOT NULL").select("client", "at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, at timestamp").parquet(str(tmp_path / "in"))
    query = limited(stream, 3, 60).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(120)
    streamed = sorted((r.client, r["at"], r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert streamed == sorted((r.client, r["at"], r.status) for r in got if r.client)


def test_the_hundred_and_first_request(spark):
    start = pd.Timestamp("2024-01-01")
    rows = [("a", start + pd.Timedelta(milliseconds=100 * i), i) for i in range(101)] + [("a", start + pd.Timedelta(seconds=60), 101)]
    log = spark.createDataFrame(pd.DataFrame(rows, columns=["client", "at", "n"])).withColumns({"most": F.lit(100), "seconds": F.lit(60)})
    assert [r.status for r in log_limited(log, ["n"]).orderBy("at").collect()] == [200] * 100 + [429, 200]
