"""An index of stored keys that a micro-batch can ask without reading the table.

Keys lie in runs, each written once: sorted by a 64-bit hash, cut into buckets by the
hash's first bits, so many that a bucket holds about `BUCKET` keys however large the run
is. Beside every bucket lies a Bloom filter of its keys. A batch reads the filters of the
buckets that its own keys fall into, and only the buckets whose filters answer: what it
reads grows with the batch, and with the number of runs, which is a few for each power of
`FAN`, since so many runs of a level are merged into one of the next. Keys that come again
mostly came lately, and stand in small runs.

What the index is made of is told by a manifest, a numbered file that is made by one
writer only; runs that it doesn't name are no part of the index, so a writer that dies
leaves nothing. Nothing expires.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from .lease import Files, Lost

#: Keys of a bucket, about; bits of a filter for each key; hash functions; runs of a level that are merged.
BUCKET, BITS, HASHES, FAN = 1 << 16, 16, 5, 4


def _slots(h: np.ndarray, n: int) -> np.ndarray:
    """Places of each hash in a filter of n bits (a power of two): a row for each function."""
    x, step = h.view(np.uint64), (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(x + np.uint64(i) * step) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - (n.bit_length() - 1)) for i in range(1, HASHES + 1)]).astype(np.int64)


def bloom(h: np.ndarray) -> bytes:
    n = max(64, 1 << (BITS * len(h) - 1).bit_length())
    bits = np.zeros(n, bool)
    bits[_slots(h, n).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(filter_: bytes, h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8))
    return bits[_slots(h, len(bits))].all(0)


class HashIndex:
    """The keys of a table, in a folder of its own. One writer at a time (see lease); readers need no lease."""

    def __init__(self, spark: SparkSession, path: str, key: str = "dedup_hash"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.files = Files(spark, self.path)
        self.refresh()

    def refresh(self) -> None:
        names = [n for n in self.files.names() if n.endswith(".manifest")]
        self.version = int(names[-1].split(".")[0]) if names else 0
        told = json.loads(self.files.read(names[-1])) if names else {}
        self.runs, self.top = told.get("runs", []), told.get("top", 0)

    @property
    def keys(self) -> int:
        return sum(r["n"] for r in self.runs)

    def _commit(self, runs: list[dict], top: int) -> None:
        text = json.dumps({"runs": runs, "top": top})
        if not self.files.create(f"{self.version + 1:012d}.manifest", text):
            raise Lost(f"index {self.path} was changed by someone else")
        gone = {r["run"] for r in self.runs} - {r["run"] for r in runs}
        self.version, self.runs, self.top = self.version + 1, runs, top
        for n in self.files.names():
            if n.endswith(".manifest") and int(n.split(".")[0]) < self.version - 1:
                self.files.delete(n)
        for run in gone:
            for kind in ("keys", "filters"):
                self.files.delete(f"{kind}/run={run}")

    def _bucket(self, depth):
        """The first `depth` bits of the hash."""
        return F.when(depth == 0, 0).otherwise(F.expr("shiftrightunsigned(h, 64 - depth)")).cast("int")

    def _write(self, keys: DataFrame, n: int, level: int) -> dict:
        """A run of n distinct keys (h and the key's column)."""
        run = max([r["run"] for r in self.runs], default=0) + 1
        while any(f"run={run}" in self.files.names(kind) for kind in ("keys", "filters")):  # left by a writer that died
            run += 1
        depth = max(0, (-(-n // BUCKET) - 1).bit_length())
        cut = keys.withColumn("depth", F.lit(depth)).withColumn("bucket", self._bucket(F.col("depth"))).drop("depth")
        tasks = min(1 << depth, int(self.spark.conf.get("spark.sql.shuffle.partitions")) * 4)
        cut.repartition(tasks, "bucket").sortWithinPartitions("bucket", "h").write.partitionBy("bucket").parquet(f"{self.path}/keys/run={run}")

        def build(group: pa.Table) -> pa.Table:
            bits = bloom(group.column("h").to_numpy())
            return pa.table({"bucket": group.column("bucket").slice(0, 1).cast(pa.int32()), "bits": pa.array([bits], pa.binary())})

        stored = self.spark.read.parquet(f"{self.path}/keys/run={run}").select("bucket", "h")
        stored.groupBy("bucket").applyInArrow(build, "bucket int, bits binary").repartition(tasks, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/filters/run={run}")
        there = {int(x.split("=")[1]) for x in self.files.names(f"filters/run={run}") if x.startswith("bucket=")}
        return {"run": run, "level": level, "depth": depth, "n": n, "empty": sorted(set(range(1 << depth)) - there)}

    def _hashed(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col(self.key), F.xxhash64(self.key).alias("h")).where(F.col(self.key).isNotNull()).distinct()

    def add(self, rows: DataFrame, top: int | None = None) -> None:
        """Adds keys that aren't there yet, as one run. top: the largest id of the table."""
        self._merge()
        keys = written(self._hashed(rows), "keys")
        n = keys.count()
        self._commit(self.runs + ([self._write(keys, n, 0)] if n else []), self.top if top is None else top)

    def _merge(self) -> None:
        """Makes one run of the runs of a level that has FAN of them."""
        while True:
            levels: dict[int, list[dict]] = {}
            for r in self.runs:
                levels.setdefault(r["level"], []).append(r)
            full = next((rs for _, rs in sorted(levels.items()) if len(rs) >= FAN), None)
            if full is None:
                return
            paths = [f"{self.path}/keys/run={r['run']}" for r in full]
            keys = self.spark.read.option("basePath", f"{self.path}/keys").parquet(*paths).select(self.key, "h")
            new = self._write(keys, sum(r["n"] for r in full), full[0]["level"] + 1)
            self._commit([r for r in self.runs if r not in full] + [new], self.top)

    def _read(self, kind: str, pairs: Iterable[tuple[int, int]]) -> DataFrame | None:
        paths = [f"{self.path}/{kind}/run={run}/bucket={bucket}" for run, bucket in pairs]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*paths) if paths else None

    def known(self, rows: DataFrame) -> DataFrame:
        """The keys of rows that are stored, each once."""
        none = self.spark.createDataFrame([], rows.select(self.key).schema)
        if not self.runs:
            return none
        places = F.array(*[F.struct(F.lit(r["run"]).alias("run"), F.lit(r["depth"]).alias("depth")) for r in self.runs])
        asked = self._hashed(rows).select("*", F.explode(places).alias("x")).select(self.key, "h", "x.run", "x.depth")
        asked = written(asked.withColumn("bucket", self._bucket(F.col("depth"))).drop("depth"), "asked")
        empty = {(r["run"], b) for r in self.runs for b in r["empty"]}
        # as many as the batch's keys at most, or as the index's buckets
        pairs = sorted({(r.run, r.bucket) for r in asked.select("run", "bucket").distinct().collect()} - empty)
        filters = self._read("filters", pairs)
        if filters is None:
            return none
        key = self.key

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            if not (len(left) and len(right)):
                return left.slice(0, 0)
            hit = may_hold(right.column("bits")[0].as_py(), left.column("h").to_numpy())
            return left.filter(pa.array(hit))

        maybe = asked.groupBy("run", "bucket").cogroup(filters.groupBy("run", "bucket")).applyInArrow(probe, asked.schema)
        maybe = written(maybe, "maybe")
        stored = self._read("keys", sorted((r.run, r.bucket) for r in maybe.select("run", "bucket").distinct().collect()))
        if stored is None:
            return none
        return maybe.join(stored.select("h", key), ["h", key], "left_semi").select(key).distinct()

    def missing(self, table: DataFrame) -> DataFrame:
        """Keys of the table that the index lacks: reads both whole, for a start and after a writer died."""
        own = table.select(self.key).where(F.col(self.key).isNotNull())
        everything = self._read_all()
        return own.distinct() if everything is None else own.distinct().join(everything, self.key, "left_anti")

    def _read_all(self) -> DataFrame | None:
        paths = [f"{self.path}/keys/run={r['run']}" for r in self.runs]
        return self.spark.read.option("basePath", f"{self.path}/keys").parquet(*paths).select(self.key) if paths else None
