"""Inserts and updates of tables, as joins: Parquet tables have no MERGE.

Each function returns what is to be written. Keys compare null-safely only
where a function says so; a batch that holds a key twice keeps one row for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key. As an aggregate: it combines before the shuffle, so a hot key is no burden."""
    values = [c for c in rows.columns if c not in keys]
    if not values:
        return rows.dropDuplicates(list(keys))
    ordered = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.struct(*values))
    return rows.groupBy(*keys).agg(F.min(ordered).alias("_first")).select(*keys, *[F.col(f"_first.col{len(order) + 1}.{v}").alias(v) for v in values]).select(rows.columns)


#: Bytes of a batch's keys up to which they are sent to every task of the table's scan.
SMALL = 64 << 20


def insert_ignore(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The batch's rows with keys that are new: the first row of each, what is stored never changes.

    The batch's keys are looked for in the table where it is read, so that only those that are stored travel on. The
    batch is written first: its size is known then, and its keys are broadcast if they are small.
    """
    first = written(first_per_key(batch, keys, order), "batch")
    wanted = first.select(*keys)
    known = existing.select(*keys).join(F.broadcast(wanted) if _bytes(wanted) <= SMALL else wanted, list(keys), "left_semi")
    return first.join(known, list(keys), "left_anti")


def new_rows(batch: DataFrame, known: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """As insert_ignore, where it is known which of the batch's keys are stored."""
    return first_per_key(batch, keys, order).join(known, list(keys), "left_anti")


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _folded(batch: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence) -> DataFrame:
    """One row for each key, what its rows come to one after another: `update` of the last, other columns of the first."""
    values = [c for c in batch.columns if c not in keys]
    if not values:
        return batch.dropDuplicates(list(keys))
    ordered = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_{i}") for i, o in enumerate(order)], F.struct(*values).alias("row"))
    ends = batch.groupBy(*keys).agg(F.min(ordered).alias("_first"), F.max(ordered).alias("_last"))
    return ends.select(*keys, *[F.col(f"{'_last' if c in update else '_first'}.row.{c}").alias(c) for c in values]).select(batch.columns)


def upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence = ()) -> DataFrame:
    """existing with the batch's rows: known keys get the columns in `update`, new keys all columns.

    A key that the batch holds several times counts as upserts one after another, in `order` (else by their values):
    the first inserts, the last updates. A column of the batch that is null overwrites; columns of existing that the
    batch lacks stay, or are null.
    """
    have = set(batch.columns)
    left = existing.withColumn("_old", F.lit(True)).alias("e")
    right = _folded(batch, keys, update, order).withColumn("_new", F.lit(True)).alias("b")
    joined = left.join(right, list(keys), "full")
    columns = []
    for c in existing.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c not in have:
            columns.append(F.col(f"e.{c}").alias(c))
        else:
            take = F.col("_new").isNotNull() if c in update else F.col("_old").isNull()
            columns.append(F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"e.{c}")).alias(c))
    return joined.select(*columns)


def with_ids(rows: DataFrame, existing: DataFrame, order: Sequence, name: str = "id") -> DataFrame:
    """rows with ids behind the largest that exists, in order.

    Rows are dealt by ranges of the order, numbered within them and written with that; then ranges are counted and
    numbers moved by what precedes them. Both look at the same written rows: ranges that are dealt twice may be cut
    at different places. No task sees all rows.
    """
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    place = F.monotonically_increasing_id()  # the range, and the row within it
    kept = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", place), "numbered")
    part = F.shiftright("_place", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    top = existing.agg(F.coalesce(F.max(name), F.lit(0)).alias("_top"))
    moved = sizes.select("_part", before.alias("_before")).join(F.broadcast(top))
    numbered = kept.withColumn("_part", part).join(F.broadcast(moved), "_part")  # ranges are as many as partitions
    within = F.col("_place") - F.shiftleft("_part", 33)
    return numbered.withColumn(name, F.col("_top") + F.col("_before") + within + 1).drop("_part", "_place", "_before", "_top")


def merge_poll_status(feeds: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """feeds after a poll. outcomes: id, status (ok, not_modified or an error), etag, last_modified.

    ok overwrites the validators, also with null; unchanged and failed polls leave them.
    """
    o = outcomes.select("id", F.col("status").alias("_s"), F.col("etag").alias("_e"), F.col("last_modified").alias("_m"))
    joined = feeds.join(o, "id", "left")
    polled, ok = F.col("_s").isNotNull(), F.col("_s") == "ok"
    return joined.withColumns(
        {
            "last_fetched_at": F.when(polled, now).otherwise(F.col("last_fetched_at")),
            "last_status": F.coalesce("_s", "last_status"),
            "etag": F.when(ok, F.col("_e")).otherwise(F.col("etag")),
            "last_modified": F.when(ok, F.col("_m")).otherwise(F.col("last_modified")),
        }
    ).select(feeds.columns)


def backfill(rows: DataFrame, column: str, value: Column) -> DataFrame:
    return rows.withColumn(column, F.coalesce(F.col(column), value))
