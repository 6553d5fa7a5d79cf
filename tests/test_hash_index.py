import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill import scratch
from pressmill.operators.upsert import insert_ignore
from pressmill.streaming import hash_index as hi
from pressmill.streaming import lease as leases
from pressmill.streaming.poll import poll

from .test_streaming import feed, land


def keys(spark, numbers):
    return spark.createDataFrame([(hashlib.sha256(str(i).encode()).hexdigest(), i) for i in numbers], "dedup_hash string, n int").coalesce(2)


def read_bytes(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(e.totalInputBytes() for e in _seq(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


def _seq(found):
    return [found.apply(i) for i in range(found.size())]


def test_filters_never_miss():
    rng = np.random.default_rng(3)
    for n in (1, 5, 1000, 70_000):
        h = rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
        f = hi.bloom(h)
        assert hi.may_hold(f, h).all() and len(f) * 8 <= max(64, 4 * hi.BITS * n)
        assert hi.may_hold(f, rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)).mean() < 0.02


@pytest.mark.parametrize("bucket", [1 << 16, 32])
def test_equals_insert_ignore(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(hi, "BUCKET", bucket)
    index, stored = hi.HashIndex(spark, f"{tmp_path}/i"), set()
    for k in range(6):
        numbers = {*range(40 * k, 40 * k + 60), *range(k), 7}
        batch = keys(spark, sorted(numbers)).unionAll(spark.createDataFrame([(None, 1)], "dedup_hash string, n int"))
        table = keys(spark, sorted(stored)) if stored else batch.where("false")
        fresh = insert_ignore(table, batch.where("dedup_hash IS NOT NULL"), ["dedup_hash"], ["n"])
        known = {r.dedup_hash for r in index.known(batch).collect()}
        assert {r.n for r in fresh.collect()} == numbers - stored
        assert known == {r.dedup_hash for r in keys(spark, sorted(numbers & stored)).collect()} if numbers & stored else not known
        index.add(fresh.select("dedup_hash"), top=k)
        stored |= numbers
        again = hi.HashIndex(spark, f"{tmp_path}/i")
        assert again.keys == len(stored) == index.keys and again.top == k and again.version == index.version
        if k in (4, 5):
            assert index.known(keys(spark, range(-500, 2000))).count() == len(stored)
            assert index.missing(keys(spark, range(60))).count() == len(set(range(60)) - stored)
    assert len(index.runs) <= 2 * hi.FAN  # runs are merged
    assert len(index.files.names("keys")) == len(index.runs) == len(index.files.names("filters"))
    assert hi.HashIndex(spark, f"{tmp_path}/none").known(keys(spark, [1])).count() == 0


def test_two_writers_can_not_both_change_it(spark, tmp_path):
    one, two = (hi.HashIndex(spark, f"{tmp_path}/i") for _ in range(2))
    one.add(keys(spark, [1, 2]))
    with pytest.raises(leases.Lost):
        two.add(keys(spark, [3]))
    again = hi.HashIndex(spark, f"{tmp_path}/i")  # what the loser wrote is no part of the index
    again.add(keys(spark, [4]))
    assert again.known(keys(spark, range(9))).count() == 3 == hi.HashIndex(spark, f"{tmp_path}/i").keys


def test_a_batch_reads_what_it_asks_for(spark, tmp_path, monkeypatch):
    """50 batches of the same size: 30 new keys and 10 that came lately. What they read stays the same while the table grows."""
    monkeypatch.setattr(hi, "BUCKET", 64)
    index, took = hi.HashIndex(spark, f"{tmp_path}/i"), []
    index.add(keys(spark, range(-4000, 0)))
    for k in range(50):
        with scratch.scope(spark):
            if k in (8, 9, 10, 11, 12, 45, 46, 47, 48, 49):
                before = read_bytes(spark)
                known = index.known(keys(spark, range(30 * k - 10, 30 * k + 30))).collect()
                took.append(read_bytes(spark) - before)
                assert len(known) == 10
            index.add(keys(spark, range(30 * k, 30 * k + 30)))
    assert index.keys == 4000 + 50 * 30
    early, late = sorted(took[:5])[2], sorted(took[5:])[2]
    everything = 66 * index.keys
    assert late < 2 * early and late < everything / 3, (early, late, everything, took)


def test_scopes_delete_what_they_wrote(spark, tmp_path):
    there = lambda: set(leases.Files(spark, scratch.shared_dir(spark)).names())
    before = there()
    with scratch.scope(spark) as keep:
        a = scratch.written(keys(spark, [1]), "a")
        with scratch.scope(spark) as inner:
            b = inner(scratch.written(keys(spark, [2]), "b"))
            scratch.written(keys(spark, [3]), "c")
        assert len(there() - before) == 2 and b.count() == 1
        keep(a)
    assert len(there() - before) == 1 and a.count() == 1


def test_a_poll_with_an_index(spark, tmp_path):
    landing, table, index = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "index")
    since = F.lit("2024-01-01").cast("timestamp")
    before = set(leases.Files(spark, scratch.shared_dir(spark)).names())

    def run():
        poll(spark, str(landing), table, str(tmp_path / "cp"), since, index=index).awaitTermination(200)
        return sorted((r.publisher_id, r.headline, r.id) for r in spark.read.parquet(table).collect())

    land(landing, "1.json", (1, 1, feed("One", " ONE ", "Two")), (2, 1, feed("two")), (3, 2, feed("One")))
    assert run() == [(1, "One", 1), (1, "Two", 2), (2, "One", 3)]
    land(landing, "2.json", (1, 1, feed("One", "Three")))
    assert run() == [(1, "One", 1), (1, "Three", 4), (1, "Two", 2), (2, "One", 3)]
    # a writer died between table and index
    with leases.held(spark, table) as lease:
        lease.append(spark.read.parquet(table).where("id = 4").withColumn("id", F.lit(5).cast("bigint")).withColumn("headline", F.lit("Four")).withColumn("dedup_hash", F.sha2(F.lit("1:four"), 256)))
    land(landing, "3.json", (1, 1, feed("Four", "Five")))
    assert run()[:2] == [(1, "Five", 6), (1, "Four", 5)]
    assert hi.HashIndex(spark, index).keys == 6
    assert set(leases.Files(spark, scratch.shared_dir(spark)).names()) == before  # no folder stays
