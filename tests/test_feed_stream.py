import json
import time

import pytest

from pressmill.sources import feeds
from pressmill.sources.feed_stream import FeedStream

from .test_pool import site  # noqa: F401


def start(spark, site, tmp_path, n, batch, every=3600, more=()):
    spark.dataSource.register(feeds.FeedSource)
    asked = [{"url": f"{site.root}/{i}"} for i in range(n)] + [{"url": site.root + x} for x in more]
    stream = spark.readStream.format("feeds").option("feeds", json.dumps(asked)).option("state", str(tmp_path / "state")).option("every", str(every)).option("slots", "4").load()
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()


def test_polls_ask_conditionally_and_never_twice(spark, site, tmp_path):  # noqa: F811
    got = []
    keep = lambda df, number: got.append(sorted((r.url.rsplit("/", 1)[1], r.status, bool(r.body), bool(r.error)) for r in df.collect()))

    def fails(df, number):
        df.collect()
        raise RuntimeError("the sink is gone")

    # the first batch fails behind its answers; a restart hands on what was landed
    query = start(spark, site, tmp_path, 6, fails, more=["/bad?kind=error"])
    with pytest.raises(Exception, match="sink is gone"):
        query.awaitTermination(120)
    assert len(site.asked) == 7 and all(tag is None for _, tag in site.asked)
    start(spark, site, tmp_path, 6, keep, more=["/bad?kind=error"]).awaitTermination(120)
    assert len(site.asked) == 7
    assert got == [sorted([(str(i), 200, True, False) for i in range(6)] + [("bad?kind=error", 500, False, True)])]
    # nothing is due: a restart asks nothing
    start(spark, site, tmp_path, 6, keep).awaitTermination(120)
    assert len(site.asked) == 7 and sum(map(len, got)) == 7
    # the next poll asks with the validators, and also a feed that is new
    start(spark, site, tmp_path, 8, keep, every=0.01).awaitTermination(120)
    later = dict(site.asked[7:15])
    assert {p: t for p, t in later.items() if p in ("/0", "/5")} == {"/0": '"/0"', "/5": '"/5"'} and later["/6"] is None
    last = next(g for g in reversed(got) if g)
    assert [x for x in last if x[1] == 304] == [(str(i), 304, False, False) for i in range(6)] or len(site.asked) > 15


def test_state_of_a_stream(site, tmp_path):  # noqa: F811
    options = {"feeds": json.dumps([{"url": f"{site.root}/{i}"} for i in range(5)]), "state": str(tmp_path), "every": "0.2", "slots": "3"}
    one = FeedStream(options)
    first = one.latestOffset()
    assert first == {"poll": 1} == one.latestOffset() and one.initialOffset() == {"poll": 0}
    parts = one.partitions({"poll": 0}, first)
    assert sum(len(p.feeds) for p in parts) == 5 and sum(p.slots for p in parts) == 3
    rows = list(one.read(parts[0]))
    again = FeedStream(options).partitions({"poll": 0}, first)  # after a restart, half of it is landed
    assert {p.landed is not None for p in again} == {True, False} and sum(len(p.feeds) for p in again) == 5 - len(rows)
    rows += [r for p in again if not p.landed for r in one.read(p)]
    assert sorted(r[0] for r in rows) == sorted(f["url"] for f in one.feeds) and len(site.asked) == 5
    assert sorted(r for p in one.partitions({"poll": 0}, first) for r in one.read(p)) == sorted(rows) and len(site.asked) == 5
    one.commit(first)
    time.sleep(0.25)
    second = FeedStream(options).latestOffset()
    assert second == {"poll": 2}
    parts = one.partitions(first, second)
    assert all(f["etag"] for p in parts for f in p.feeds)
    assert {(r[1], r[2], r[3] is not None) for p in parts for r in one.read(p)} == {(304, None, True)}
    one.commit(second)
    assert len(one._validators(2)) == 5 and {what for _, what in one._names()} == {"begun", "validators"}
    assert one.partitions(second, second) == []
