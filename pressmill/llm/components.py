"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is a few aggregations and joins whose rows are about as many as the
links; its links are written to the shared folder, so lineage stays short and
an executor can be lost. Nodes are longs; only counts reach the driver. The links
of a hub, which may be a third of all, are dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import salt, written


def _with_least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links with m, the least v of their u, and a row of u and m for each u. A hub's links are dealt to many tasks."""
    share = salt("v").alias("share")
    least = links.groupBy("u", share).agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_set("share").alias("shares"))
    return links.select("*", share).join(least.select("u", "m", F.explode("shares").alias("share")), ["u", "share"]), least


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both)[0].where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    joined, least = _with_least(links)
    moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v): root is the least node it is linked with, at any distance.

    Links from a node to itself and repeated links count as none and one; nodes without links give no row.
    """
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now, before = written(down, "links"), None
    while True:
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
        if sign == before:
            break
        before = sign
        now = written(_small_star(_large_star(now)).where("u != v").distinct(), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
