"""What the operators share: written intermediate tables, Arrow batches, word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import dropped, new_path, packed, written  # noqa: F401

#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 1 << 21


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has (letter case aside)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a row number that tells repeated rows apart, and the number's column.

    The numbered rows are written, since only what is written has the same numbers each time it is read.
    """
    name = fresh("_uid", df)
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_in_bytes(df: DataFrame) -> int:
    """Bytes of df's files, as Spark's optimizer knows them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame, most: int) -> int:
    """Partitions for a shuffle of df: the session's number, or more where a partition would pass `most` bytes of its files."""
    size = size_in_bytes(df)
    known = size < 1 << 60  # frames that aren't of files have no size
    return max(partitions(df.sparkSession), -(-size // most) if known else 1)


#: Tasks that rows of one key are dealt to, where a key may be hot.
SALTS = 64


def salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(lengths: np.ndarray, most: int = CHUNK_BYTES):
    """(from, to) of row ranges of about `most` bytes each."""
    total, begin = 0, 0
    for i, n in enumerate(lengths.tolist()):
        total += n
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(lengths):
        yield begin, len(lengths)


#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def word_spans(texts: list[bytes], table: np.ndarray):
    """Words of lower-cased texts laid end to end.

    Returns the bytes, the words' starts and ends in them, and for each text the
    index of its first word (one more entry than texts).
    """
    joined = b"\n".join(texts).lower()  # bytes.lower touches A-Z only
    buf = np.frombuffer(joined + b"\n", np.uint8)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[1:] = table[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return buf, starts, ends, np.searchsorted(starts, bounds)


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES)
        back = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, back)]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from polynomial prefix sums over a few MB at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_BYTES)))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(buf[lo:hi].astype(np.uint64) * up[: hi - lo], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return mixed(out)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, from the words' hashes; shorter by k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mixed(out)
