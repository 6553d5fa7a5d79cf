"""Constraints as checks that return their violations, and reports on publishers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (without nulls) that occur more than once, with their number n."""
    filled = table.dropna(subset=keys)
    return filled.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outside(table: DataFrame, column: str, allowed: list) -> DataFrame:
    """Values that are not allowed, with their number; null is no violation."""
    return table.where(~F.col(column).isin(allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def orphans(table: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose column has a value that the parent's key has not."""
    return table.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def nulls(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many nulls each column has."""
    return table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def shared_domains(publishers: DataFrame, domain: str, name: str, iso: str) -> DataFrame:
    """Domains of more than one publisher: n, and their names and countries in order."""
    # the listing grows with the publishers of a domain, which is what the report shows
    each = F.struct(F.col(iso).alias("iso"), F.col(name).alias("name"))
    listed = F.transform(F.sort_array(F.collect_list(each)), lambda x: F.concat(x["name"], F.lit(" ("), x["iso"], F.lit(")")))
    return publishers.groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("n"), F.array_join(listed, ", ").alias("listing")).where("n > 1")


def similar_names(publishers: DataFrame, group: str, name: str, order: list[str]) -> DataFrame:
    """(group, name_a, name_b): pairs of a group whose keys differ and one of which holds the other.

    Keys of a group are looked up among the parts of the longer keys that are as long as some key of the
    group, an equi-join that grows with the names' length, not with the square of a group. A key without letters or digits is part of all.
    """
    key = name_key(F.col(name))
    rows = publishers.select(F.col(group).alias("group"), F.col(name).alias("name"), key.alias("key"), F.struct(*order).alias("at"))
    # parts of the lengths that a group's keys have: as many lengths as the longest name at most
    sizes = rows.groupBy("group").agg(F.collect_set(F.length("key")).alias("sizes"))
    size = F.length("key")
    own = F.filter("sizes", lambda n: (n > 0) & (n < size))
    spans = F.flatten(F.transform(own, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("key"), i, n))))
    parts = F.when(size > 0, F.array_append(F.array_distinct(spans), F.lit("")))
    rows = rows.join(sizes, "group")
    longer = rows.select("group", F.col("name").alias("long"), F.col("at").alias("long_at"), F.explode(parts).alias("key"))
    shorter = rows.select("group", F.col("name").alias("short"), F.col("at").alias("short_at"), "key")
    found = longer.join(shorter, ["group", "key"])
    first = F.col("long_at") < F.col("short_at")
    return found.select("group", F.when(first, F.col("long")).otherwise(F.col("short")).alias("name_a"), F.when(first, F.col("short")).otherwise(F.col("long")).alias("name_b"))


def ordinals(rows: DataFrame, group: str, order: list[str], name: str = "ordinal") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def disagreeing(rows: DataFrame, key: str, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose column differs from that of the parent they name: row, what it has, and what the parent has."""
    p = parent.select(F.col(parent_key).alias(key), F.col(column).alias("expected"))
    return rows.join(p, key).where(~F.col(column).eqNullSafe(F.col("expected")))
