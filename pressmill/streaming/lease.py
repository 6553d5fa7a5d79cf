"""Leases: one writer of a table at a time, whatever machine it runs on.

A lease is a numbered file beside the table, made by an operation that the file system
carries out for one caller only. Its number fences: it grows with each lease, and only
the holder of the largest may write. A lease ends when it is released or when its time
is up, so a holder that was killed keeps others waiting no longer than that; its
successor can tell, and sees what is half done.

What a holder appends is written beside the table, under its number. Then the lease is
checked once more and the files are moved in, so between check and table there are only
renames, and a holder that slept through the end of its lease adds nothing.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Seconds after which a poll gives up, and with it its lease.
DEADLINE = 280


class Busy(Exception):
    """Someone else holds the lease."""


class Lost(Exception):
    """The lease's time is up, or someone has a later one."""


class Files:
    """The few operations that leases and manifests need, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, below: str = "") -> list[str]:
        where = self._path(below)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def create(self, name: str, text: str) -> bool:
        """Whether the file is this caller's: of several who try, one succeeds. Local files appear with their text, others empty at first."""
        self.fs.mkdirs(self._path(""))
        if self.fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and writes then; a link is one step
            place = self._path(name).toUri().getPath()
            draft = f"{place}.{uuid.uuid4().hex}.draft"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(draft, place)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or self.fs.exists(self._path(name)):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self._path(name), self._hadoop.Path(to)):
            raise OSError(f"{name} can't be moved to {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _number(name: str) -> int:
    return int(name.split(".")[0])


@dataclass
class Lease:
    table: str
    files: Files
    number: int
    until: float
    #: Whether the lease before was left without being released, so that its holder's work may be half done.
    inherited: bool
    parts: int = field(default=0)

    def check(self) -> None:
        """Raises Lost unless this is the latest lease and its time isn't up."""
        latest = max((_number(n) for n in self.files.names() if n.endswith(".lease")), default=0)
        if latest != self.number or time.time() >= self.until:
            raise Lost(f"lease {self.number} of {self.table}")

    def append(self, rows: DataFrame) -> None:
        """Appends rows to the table, or raises Lost and adds nothing."""
        self.parts += 1
        staged = f"{self.number:012d}.{self.parts}.staged"
        rows.write.mode("overwrite").parquet(f"{self.files.folder}/{staged}")
        self.check()
        self.files.fs.mkdirs(self.files._hadoop.Path(self.table))
        for name in self.files.names(staged):
            if name.startswith("part-"):
                self.files.move(f"{staged}/{name}", f"{self.table}/lease-{self.number:012d}-{self.parts}-{name}")
        self.files.delete(staged)

    def release(self) -> None:
        self.files.create(f"{self.number:012d}.released", "")


def acquire(spark: SparkSession, table: str, seconds: float = DEADLINE, wait: float = 0) -> Lease:
    """The table's lease for so many seconds. Raises Busy if someone holds it, `wait` seconds from now still."""
    files, end = Files(spark, table.rstrip("/") + ".leases"), time.time() + wait
    while True:
        names = files.names()
        last = max((n for n in names if n.endswith(".lease")), default=None)
        number, inherited, free = 1, False, True
        if last:
            number = _number(last) + 1
            released = f"{_number(last):012d}.released" in names
            told = files.read(last)
            until = json.loads(told)["until"] if told else time.time() + DEADLINE - files.age(last)
            inherited, free = not released, released or time.time() >= until
        if free:
            until = time.time() + seconds
            if files.create(f"{number:012d}.lease", json.dumps({"until": until, "seconds": seconds})):
                for old in names:  # all but the one before: its number is needed should this one fail
                    if _number(old) < number - 1:
                        files.delete(old)
                return Lease(table.rstrip("/"), files, number, until, inherited)
        if time.time() >= end:
            raise Busy(table)
        time.sleep(0.1)


@contextlib.contextmanager
def held(spark: SparkSession, table: str, seconds: float = DEADLINE, wait: float = 0) -> Iterator[Lease]:
    """The lease for a block of work; one that ends by an error isn't released, so whoever comes next knows."""
    lease = acquire(spark, table, seconds, wait)
    yield lease
    lease.release()
