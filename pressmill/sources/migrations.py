"""Migrations: SQL files that are run once each, in order of their names.

Tables are Spark's own (CREATE TABLE ... USING parquet, ALTER TABLE ... ADD COLUMNS with
defaults), so a file's statements go to Spark as they are; rows from before a column was
added have its default. A ledger keeps a file's name and checksum once all of it ran and
the rules of its tables hold. A file that failed is run again from its beginning, so
statements should not mind that (IF NOT EXISTS). One runner at a time, by a lease.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.lease import Files, acquire
from .tables import statements


class Changed(Exception):
    """A file that was applied isn't what it was, or is gone."""


class Broken(Exception):
    """Rows of a table break a rule."""


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def applied(spark: SparkSession, ledger: str) -> dict[str, str]:
    """The checksum of each file that was applied."""
    files = Files(spark, ledger)
    return {n.removesuffix(".applied"): json.loads(files.read(n))["sha256"] for n in files.names() if n.endswith(".applied")}


def broken(table: DataFrame, rules: dict[str, str]) -> dict[str, int]:
    """How many rows break each rule (a condition that must not be false), in one pass; rules that hold are left out."""
    if not rules:
        return {}
    counts = table.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()]).head().asDict()
    return {name: n for name, n in counts.items() if n}


def migrate(spark: SparkSession, folder: str, ledger: str, rules: dict[str, dict[str, str]] | None = None, seconds: float = 3600) -> list[str]:
    """Runs the files that are new, and returns their names. rules: by table, conditions by name that its rows must keep.

    Nothing is run if a file that was applied has changed.
    """
    lease = acquire(spark, f"{ledger.rstrip('/')}/runner", seconds, wait=seconds)
    try:
        found = {r["name"]: r.text for r in statements(spark, folder).collect()}  # as many as there are files
        known = applied(spark, ledger)
        for name, digest in known.items():
            if name not in found or _digest(found[name]) != digest:
                raise Changed(name)
        done = []
        for name in sorted(found.keys() - known.keys()):
            for statement in re.split(r";[ \t]*(?:\n|$)", found[name]):
                if re.sub(r"--[^\n]*", "", statement).strip():
                    lease.check()
                    spark.sql(statement)
            for table, own in (rules or {}).items():
                if spark.catalog.tableExists(table) and (bad := broken(spark.table(table), {n: r for n, r in own.items() if _applies(spark, table, r)})):
                    raise Broken(f"{name}: {table} {bad}")
            Files(spark, ledger).create(f"{name}.applied", json.dumps({"sha256": _digest(found[name])}))
            done.append(name)
        return done
    finally:
        lease.release()  # what failed is told by its absence from the ledger


def _applies(spark: SparkSession, table: str, rule: str) -> bool:
    """Whether the table has the rule's columns by now."""
    from pyspark.errors import AnalysisException

    try:
        spark.table(table).select(F.expr(rule))
        return True
    except AnalysisException:
        return False
