"""Polling as a stream: landed feed documents become articles, each stored once.

State is the articles table itself: a hash that is stored is never inserted
again, however late it comes, so no watermark may expire it. A micro-batch that
is run again finds its own rows stored and adds nothing. With an index (hash_index)
a micro-batch reads what its own hashes call for, not all of the table's.

Ids go on behind the largest stored one. What a poll did to each feed is appended
to a log, by micro-batch; ``feeds_now`` merges the latest of it into the feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.upsert import merge_poll_status
from ..plans.ingest import article_rows, indexed_articles, items_of, new_articles, outcomes
from ..scratch import scope, written
from ..sources.feeds import feed_items
from ..sources.tables import stored
from .hash_index import HashIndex
from .lease import DEADLINE, Lease, held

DOCUMENTS = "id int, publisher_id int, country_id int, feed_type string, body string, status int, etag string, last_modified string, error string"
LOG = "id int, status string, etag string, last_modified string, batch bigint"


def poll(spark: SparkSession, landing: str, table: str, checkpoint: str, since: Column, every: str | None = None, log: str | None = None, index: str | None = None, deadline: float = DEADLINE) -> StreamingQuery:
    """Starts a query over JSON documents under landing. every: a processing-time trigger, else what is there is run once.

    index: where an index of the stored hashes is kept, so that a micro-batch reads no more of the table than it must.
    log: where outcomes of the feeds are appended. Queries over one table take turns, by a lease for each micro-batch,
    which ends after `deadline` seconds.
    """
    landed = spark.readStream.schema(DOCUMENTS).json(landing)
    columns = schemas.articles().names

    known: list[HashIndex] = []

    def batch(documents: DataFrame, number: int) -> None:
        session = documents.sparkSession
        with scope(session):  # what a micro-batch writes for itself goes away with it
            parsed = written(feed_items(documents), "parsed")
            rows = article_rows(items_of(parsed), since)
            with held(session, table, deadline, wait=deadline) as lease:
                if index:
                    _by_index(session, lease, rows)
                else:
                    lease.append(new_articles(stored(session, table), rows).withColumn("fetched_at", F.current_timestamp()).select(columns))
            if log:  # a batch that runs again writes its folder again
                outcomes(parsed).withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{log}/batch={number}")

    def _by_index(session: SparkSession, lease: Lease, rows: DataFrame) -> None:
        """Appends what the index doesn't know. Table and index may differ where a writer died, so both are read whole at the start and after that."""
        if not known or lease.inherited:
            known[:] = [HashIndex(session, index)]
            there = stored(session, table)
            known[0].add(known[0].missing(there), there.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0])
        known[0].refresh()  # another query may have added to it
        fresh = written(indexed_articles(known[0], rows).withColumn("fetched_at", F.current_timestamp()).select(columns), "fresh")
        if n := fresh.count():
            lease.append(fresh)
            known[0].add(fresh, known[0].top + n)

    writer = landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def feeds_now(feeds: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """feeds after all logged polls: validators of the latest poll that went well, the status of the latest of all."""
    good = F.struct("batch", "etag", "last_modified")
    latest = log.groupBy("id").agg(F.max_by("status", F.struct("batch", "status")).alias("status"), F.max(F.when(F.col("status") == "ok", good)).alias("good"))
    done = merge_poll_status(feeds, latest.select("id", "status", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified")), now)
    kept = feeds.select("id", F.col("etag").alias("_e"), F.col("last_modified").alias("_m")).join(latest.select("id", "good"), "id", "left")
    known = F.col("good").isNotNull()
    kept = kept.select("id", F.when(known, F.col("good.etag")).otherwise(F.col("_e")).alias("etag"), F.when(known, F.col("good.last_modified")).otherwise(F.col("_m")).alias("last_modified"))
    return done.drop("etag", "last_modified").join(kept, "id").select(feeds.columns)
