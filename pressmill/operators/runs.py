"""Values carried along an order of rows, and chains of jumps in it, without a task that sees all rows.

Rows are numbered by `upsert.with_ids`. A block of `BLOCK` neighbours is a window of its
own; what goes from block to block is one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .upsert import with_ids

BLOCK = 1 << 16


def placed(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in the order, from 1 on."""
    none = rows.sparkSession.createDataFrame([], f"{name} bigint")
    return with_ids(rows, none, order, name)


def carried(rows: DataFrame, place: str, value: Column, name: str) -> DataFrame:
    """rows with the last value that isn't null, at their place or before it."""
    inner = Window.partitionBy("_block").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.withColumns({"_block": F.floor(F.col(place) / BLOCK), "_value": value})
    ends = cut.groupBy("_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(place))).alias("_end"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    ends = ends.select("_block", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    filled = cut.withColumn("_own", F.last("_value", ignorenulls=True).over(inner)).join(ends, "_block")
    return filled.withColumn(name, F.coalesce("_own", "_before")).drop("_block", "_value", "_own", "_before")


def reached(first: DataFrame, jumps: DataFrame) -> DataFrame:
    """The places that are reached from those in first(place) by jumps(place, to), themselves included.

    Jumps are doubled each round, so there are as many rounds as the longest chain has binary digits, each of which is
    two joins by place: a chain is followed in many places at once. A jump leads to a later place.
    """
    seen, leap = written(first.select("place"), "reached"), written(jumps.select("place", "to").where("to IS NOT NULL"), "jumps")
    count, n = -1, seen.count()
    while n != count:
        count = n
        more = seen.join(leap, "place").select(F.col("to").alias("place"))
        seen = written(seen.unionAll(more).distinct(), "reached")
        further = leap.select(F.col("place").alias("from"), F.col("to").alias("place")).join(leap, "place").select(F.col("from").alias("place"), "to")
        leap, n = written(further, "jumps"), seen.count()
    return seen
