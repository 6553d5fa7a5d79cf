"""A whole poll: plan, fetch, parse, store once, and what it did to each feed."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates
from ..operators.upsert import merge_poll_status
from ..sources.feeds import TIMEOUT, feed_items, fetch, shares
from ..sources.pool import completed
from ..sources.tables import stored
from ..streaming.lease import Busy, acquire
from . import ingest, read_api

FETCHED = "id int, publisher_id int, country_id int, feed_type string, status int, body string, etag string, last_modified string, error string"
#: Requests that are open at a time, and the tasks that they are shared out among.
SLOTS, TASKS = 20, 2
#: Seconds after which a poll asks no more feeds.
DEADLINE = 280
#: Characters of answers that a task hands on together.
BUFFER = 4 << 20


def fetched(plan: DataFrame, slots: int = SLOTS, tasks: int = TASKS, seconds: float = TIMEOUT, deadline: float = DEADLINE) -> DataFrame:
    """Each feed of the plan, requested once, in order of completion. A failure is a row with its error.

    Slots are shared out among a few tasks, whose feeds wait in one queue: whichever slot is free takes the next, so
    a feed that hangs delays no other, and all `tasks` together never have more than `slots` requests open. Feeds that
    haven't been asked `deadline` seconds after their task began are rows with that error.
    """
    tasks = max(1, min(tasks, slots))
    names = [f.split()[0] for f in FETCHED.split(", ")]
    own = shares(slots, tasks)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine, until = own[TaskContext.get().partitionId() % tasks], time.monotonic() + deadline
        asked = (row for batch in batches for row in batch.to_pylist())
        ready, held = [], 0
        for done in completed(asked, lambda r: fetch(r["feed_url"], r["etag"], r["last_modified"], seconds), mine, seconds + 1, until):
            if done:
                row, answer, error = done
                _, status, body, etag, modified, told = answer or (None, None, None, None, None, str(error) or type(error).__name__)
                ready.append((row["id"], row["publisher_id"], row["country_id"], row["feed_type"], status, body, etag, modified, told))
                held += len(body or "")
            if ready and (done is None or held > BUFFER or len(ready) >= 64):
                yield _rows(ready, names)
                ready, held = [], 0
        if ready:
            yield _rows(ready, names)

    return plan.select("id", "publisher_id", "country_id", "feed_type", "feed_url", "etag", "last_modified").repartition(tasks).mapInArrow(get, FETCHED)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


@dataclass
class Poll:
    articles: DataFrame  # to append
    feeds: DataFrame  # the feeds table afterwards
    summary: DataFrame  # one row: feeds, ok, inserted


def poll_once(spark: SparkSession, feeds: DataFrame, publishers: DataFrame, stored: DataFrame, landing: str, now: Column, slots: int = SLOTS) -> Poll:
    """Polls the feeds of active publishers. What was fetched is written under landing, so that no feed is asked twice."""
    fetched(read_api.poll_plan(feeds, publishers), slots).write.parquet(landing)
    parsed = feed_items(spark.read.schema(FETCHED).parquet(landing))
    rows = ingest.article_rows(ingest.items_of(parsed), dates.cutoff(now))
    fresh = ingest.new_articles(stored, rows).withColumn("fetched_at", now)
    done = ingest.outcomes(parsed)
    inserted = fresh.groupBy(F.col("feed_id").alias("id")).agg(F.count("*").alias("inserted"))
    results = done.join(inserted, "id", "left").select((~F.startswith("status", F.lit("error"))).alias("ok"), "inserted")
    return Poll(fresh, merge_poll_status(feeds, done, now), ingest.summary(results))


def poll_alone(spark: SparkSession, feeds: DataFrame, publishers: DataFrame, table: str, landing: str, now: Column, slots: int = SLOTS, seconds: float = DEADLINE) -> Poll | None:
    """A poll that no other overlaps: its articles are appended to the table under a lease. None, and nothing asked, if a poll is running.

    A poll that isn't done after `seconds` loses its lease and appends nothing.
    """
    try:
        lease = acquire(spark, table, seconds)
    except Busy:
        return None
    try:
        done = poll_once(spark, feeds, publishers, stored(spark, table), landing, now, slots)
        lease.append(done.articles.select(schemas.articles().names))
        return done
    finally:
        lease.release()  # what was staged and not moved in is no part of the table
