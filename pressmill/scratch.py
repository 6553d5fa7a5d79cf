"""Intermediate tables: Parquet in the folder that driver and executors share, so that they outlive lost executors."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the innermost scope.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see. Only a local session may leave it unnamed, and has one of its own then."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"shared-{context.applicationId}")
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder that is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if (inside := _scope.get()) is not None:
        inside.append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what is written within it, for work that goes on for ever or step by step.

    Yields a function that keeps a written table for whatever is outside.
    """
    inside: list[str] = []
    outer = _scope.set(inside)
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        files = df.inputFiles()
        kept.update(p for p in inside if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files))
        return df

    try:
        yield keep
    finally:
        _scope.reset(outer)
        if (around := _scope.get()) is not None:
            around.extend(kept)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in inside:
            if path not in kept:
                hadoop = jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(conf).delete(hadoop, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, tag: str) -> DataFrame:
    """written(), in files that take less room and a little more time: for large tables that stay for long."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them must be written, too."""
    for df in tables:
        if files := df.inputFiles():
            spark = df.sparkSession
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
