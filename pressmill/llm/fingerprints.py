"""Document fingerprints: digests of improbable features, for likeness after edits.

A feature is a window of WINDOW bytes. Its entropy, in thousandths of the most that a
window can have, is looked up in a table that counts how often windows of all
documents have it: the rarer, the lower its rank. In every run of RUN windows the
lowest rank, the leftmost of equals, has a vote; windows with enough votes are the
text's features, in order, each once. A window's choice depends on its neighbourhood
only, so an edit moves features only beside it. Short texts have all their windows of SHORT bytes. PER_FILTER features at a time go to
Bloom filters of FILTER_BYTES, one behind the other. Two digests are compared by their
filters' common bits, less what chance gives two filters so full, over the most that
they could share; each filter of the smaller digest takes its best partner.

Documents are dealt out by ranges of descending doc_id and read once in that order, so
a document meets the next one in the same task; what is missing at a range's end, one
document for each range, is joined afterwards. The table of ranks is RANKS numbers. It
comes from a pass over all texts, in which each task counts for itself.

Null texts are empty. A text of fewer bytes than a short window is one feature, an empty
one has none; two empty digests are alike (1), an empty and another are not (0). Equal
texts have equal digests. Documents without doc_id come last; equal doc_ids are taken
in the order of their texts' hashes, then texts, so repeated rows have one another as
next. The only document has itself. Long texts are read whole, in segments; columns
other than doc_id and text are ignored. An empty table gives no rows. Features count
as equal by a 64-bit hash.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import CHUNK_BYTES, chunks, mixed, pieces, text_bytes, written

WINDOW, RUN, VOTES = 32, 64, 16
#: Texts of fewer bytes than SHORT_BELOW have all windows of SHORT bytes as features; those of LONG_FROM and more have chosen
#: ones. Between the two they have both, so that a text which an edit makes a third shorter still has a kind in common with it.
SHORT, LONG_FROM, SHORT_BELOW = 8, 192, 288
FILTER_BYTES, HASHES, PER_FILTER = 256, 5, 160
BITS = 8 * FILTER_BYTES
RANKS = 1001
#: Of the room between chance and all bits, so much counts as none; and never less than so many deviations of chance.
MARGIN, DEVIATIONS = 0.1, 4.0
#: Windows that are looked at together, so that they stay in a core's cache.
SEGMENT = 1 << 17
_PLACE = 20  # bits of a place within a segment
#: Bytes of files that a range of documents takes.
RANGE_BYTES = 64 << 20

#: c * log2(c), in whole numbers: sums are the same in any order.
_WEIGHT = np.array([0] + [round(c * math.log2(c) * 1024) for c in range(1, WINDOW + 1)], np.int32)
_STEP = np.diff(_WEIGHT)  # by how much one more of a byte raises the sum
_MOST = int(_WEIGHT[WINDOW])


def entropies(buf: np.ndarray) -> np.ndarray:
    """The entropy of each window of buf in thousandths, from how often each byte recurs nearby."""
    n = len(buf) - WINDOW + 1
    ahead, behind = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    for o in range(1, WINDOW):
        same = (buf[o:] == buf[:-o]).view(np.uint8)
        ahead[:-o] += same
        behind[o:] += same
    sums = np.empty(n, np.int32)
    sums[0] = _WEIGHT[np.bincount(buf[:WINDOW])].sum()
    if n > 1:  # a window loses its first byte and gains one
        np.cumsum(_STEP[behind[WINDOW:]] - _STEP[ahead[: n - 1]], out=sums[1:])
        sums[1:] += sums[0]
    return (_MOST - sums) * np.int32(RANKS - 1) // np.int32(_MOST)


class Laid:
    """Texts end to end, with room between them that no window may enter."""

    def __init__(self, texts: list[bytes]):
        gap = bytes(RUN + WINDOW)
        self.buf = np.frombuffer(gap.join([*texts, b""]), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(sizes + len(gap))])[:-1]
        self.sizes = sizes
        self.windows = np.where(sizes >= LONG_FROM, sizes - WINDOW + 1, 0)

    def _mask(self, counts: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.buf) + 1, np.int8)
        some = counts > 0
        edge[self.starts[some]] = 1
        edge[(self.starts + counts)[some]] -= 1
        return np.cumsum(edge[:-1], dtype=np.int8).view(bool)

    def segments(self):
        """(from, to, entropies) of all places; entropies reach RUN - 1 windows beyond `to` where there are so many."""
        last = len(self.buf) - WINDOW + 1
        for lo in range(0, max(last, 0), SEGMENT):
            hi = min(lo + SEGMENT, last)
            yield lo, hi, entropies(self.buf[lo : min(hi + RUN - 1, last) + WINDOW - 1])

    def counted(self) -> np.ndarray:
        """How many windows have each entropy."""
        real, out = self._mask(self.windows), np.zeros(RANKS, np.int64)
        for lo, hi, h in self.segments():
            out += np.bincount(h[: hi - lo][real[lo:hi]], minlength=RANKS)
        return out

    def votes(self, ranks: np.ndarray) -> np.ndarray:
        """For each place the runs in which its window has the lowest rank."""
        real = self._mask(self.windows)
        runs = self._mask(np.where(self.windows > 0, np.maximum(self.windows - RUN, 0) + 1, 0))
        out = np.zeros(len(self.buf), np.uint8)
        for lo, hi, h in self.segments():
            key = ranks[h] << np.uint32(_PLACE) | np.arange(len(h), dtype=np.uint32)
            key[~real[lo : lo + len(h)]] = 0xFFFFFFFF
            key = np.concatenate([key, np.full(RUN - 1, 0xFFFFFFFF, np.uint32)])
            width = 1
            while width < RUN:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            won = key[: hi - lo][runs[lo:hi]] & np.uint32((1 << _PLACE) - 1)
            n = np.bincount(won)
            out[lo : lo + len(n)] += n.astype(np.uint8)
        return out

    def features(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the chosen windows, short ones first, then by place; a hash once for each text."""
        votes = self.votes(ranks)
        place = np.flatnonzero(votes)
        text = np.searchsorted(self.starts, place, "right") - 1
        # shorter texts ask for fewer votes; some window of each has as many as are asked for
        asked = np.clip(self.windows // RUN, 1, VOTES)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        if len(place):
            asked[text[first]] = np.minimum(asked[text[first]], np.maximum.reduceat(votes[place], first))
        keep = votes[place] >= asked[text]
        found = [(text[keep], place[keep], self._hashed(place[keep], WINDOW))]
        short = np.flatnonzero((self.sizes >= SHORT) & (self.sizes < SHORT_BELOW))
        n = self.sizes[short] - SHORT + 1
        own = np.repeat(self.starts[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append((np.repeat(short, n), own - len(self.buf), self._hashed(own, SHORT)))  # before all others
        text, place, h = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.lexsort((place, h, text))
        new = np.ones(len(by), bool)
        new[1:] = (h[by][1:] != h[by][:-1]) | (text[by][1:] != text[by][:-1])
        by = by[new]
        by = by[np.lexsort((place[by], text[by]))]
        return text[by], h[by]

    def _hashed(self, place: np.ndarray, width: int) -> np.ndarray:
        wide = np.ascontiguousarray(self.buf[place[:, None] + np.arange(width)]).view("<u8")
        h = np.full(len(place), width, np.uint64)
        for i in range(wide.shape[1]):
            h = mixed(h + wide[:, i])
        return h


def digests(texts: list[bytes], ranks: np.ndarray) -> list[tuple[int, bytes]]:
    """(features, filters) of each text."""
    out = []
    lengths = np.fromiter((len(t) + RUN + WINDOW for t in texts), np.int64, len(texts))
    for lo, hi in chunks(lengths, CHUNK_BYTES):
        out += _digests(texts[lo:hi], ranks)
    return out


def _digests(texts: list[bytes], ranks: np.ndarray) -> list[tuple[int, bytes]]:
    text, h = Laid(texts).features(ranks)
    tiny = np.array([i for i, t in enumerate(texts) if 0 < len(t) < SHORT], np.int64)
    if len(tiny):
        own = [int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in tiny.tolist()]
        text, h = np.concatenate([text, tiny]), np.concatenate([h, np.array(own, np.uint64)])
        by = np.argsort(text, kind="stable")
        text, h = text[by], h[by]
    n = np.bincount(text, minlength=len(texts))
    filters = -(-n // PER_FILTER)
    first = np.cumsum(filters) - filters
    within = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    bits = np.zeros(int(filters.sum()) * BITS, bool)
    base = (first[text] + within // PER_FILTER) * BITS
    for i in range(HASHES):
        bits[base + (h >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = True
    raw = np.packbits(bits).tobytes()
    return [(c, raw[a * FILTER_BYTES : (a + f) * FILTER_BYTES]) for c, a, f in zip(n.tolist(), first.tolist(), filters.tolist(), strict=True)]


def likeness(a: tuple[int, bytes], b: tuple[int, bytes]) -> float:
    """0 to 1: how much of the smaller digest is in the other."""
    if a == b:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    small, large = sorted((a, b), key=lambda d: (len(d[1]), d))
    x, y = (np.frombuffer(d[1], np.uint64).reshape(-1, FILTER_BYTES // 8) for d in (small, large))
    sizes = np.full(len(x), PER_FILTER)
    sizes[-1] = small[0] - PER_FILTER * (len(x) - 1)
    set_y = np.bitwise_count(y).sum(1).astype(np.float64)
    total = 0.0
    for i in range(len(x)):  # a filter against all of the other's
        set_x = float(np.bitwise_count(x[i]).sum())
        common = np.bitwise_count(x[i] & y).sum(1)
        chance, most = set_x * set_y / BITS, np.minimum(set_x, set_y)
        deviation = np.sqrt(chance * (BITS - set_x) * (BITS - set_y) / (BITS * (BITS - 1)))
        floor = chance + np.maximum(MARGIN * (most - chance), DEVIATIONS * deviation)
        room = most - floor
        score = np.where(room > 0, (common - floor) / np.where(room > 0, room, 1), 0)
        total += float(sizes[i]) * min(max(float(score.max()), 0.0), 1.0)
    return total / small[0]


def shown(digest: tuple[int, bytes]) -> str:
    return f"{digest[0]}:{base64.b64encode(digest[1]).decode()}"


def parsed(fingerprint: str) -> tuple[int, bytes]:
    n, filters = fingerprint.split(":")
    return int(n), base64.b64decode(filters)


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy: the fewer windows of all documents have it, the lower."""

    def count(batches):
        total = np.zeros(RANKS, np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for lo, hi in chunks(np.fromiter(map(len, texts), np.int64, len(texts))):
                total += Laid(texts[lo:hi]).counted()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["entropy", "n"])

    counts = np.zeros(RANKS, np.int64)
    for r in docs.select("text").mapInArrow(count, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect():
        counts[r.entropy] = r.n
    ranks = np.empty(RANKS, np.uint32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(RANKS, dtype=np.uint32)
    return ranks


def digested(docs: DataFrame, ranks: np.ndarray, column: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text, under a table of ranks."""

    def scan(parts):
        for text in parts:
            yield pd.Series([shown(d) for d in digests([t.encode() if isinstance(t, str) else b"" for t in text], ranks)], dtype=object)

    return docs.withColumn(column, F.pandas_udf(scan, "string", F.PandasUDFType.SCALAR_ITER)("text"))


_FOUND = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(texts: list[str], following: list[str]) -> list[bytes]:
    return [(t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode() for t, u in zip(texts, following, strict=True)]


def _compared(texts: list[str], own: list, following: list[str], theirs: list, ranks: np.ndarray) -> list[list]:
    """The columns of _FOUND for texts, their digests, the next texts and theirs."""
    new = _edited(texts, following)
    changed = digests(new, ranks)
    return [
        [len(t) for t in texts],
        [hashlib.sha256(e).hexdigest() for e in new],
        [shown(d) for d in own],
        [shown(d) for d in changed],
        [likeness(a, b) for a, b in zip(own, changed, strict=True)],
        [likeness(a, b) for a, b in zip(own, theirs, strict=True)],
    ]


def _table(ids: pa.Array, found: list[list], kind: int, part: int, texts: list) -> pa.RecordBatch:
    n = len(ids)
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = [pa.array(c, t) for c, t in zip(found, types, strict=True)]
    return pa.RecordBatch.from_arrays([ids, *columns, pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(texts, pa.string())], ["doc_id", *_FOUND, "kind", "part", "text"])


#: Rows of a range's result: found whole, and its ends, which wait for the ranges beside it.
WHOLE, FIRST, LAST = 0, 1, 2


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document, in descending doc_id: its digest, that of the text with its last third replaced by the next text's beginning, and likenesses."""
    ranks = rarity(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None  # the last document so far: id, text, digest
        blank = [[None]] * len(_FOUND)
        end = lambda which, d: _table(d[0], [*blank[:2], [shown(d[2])], *blank[3:]], which, part, [d[1]])
        for batch in batches:
            raw = text_bytes(batch.column(1))
            for lo, hi in chunks(np.fromiter(map(len, raw), np.int64, len(raw))):
                ids, own = batch.column(0).slice(lo, hi - lo), digests(raw[lo:hi], ranks)
                texts = [t.decode() for t in raw[lo:hi]]
                if held is None:
                    yield end(FIRST, (ids.slice(0, 1), texts[0], own[0]))
                else:
                    ids, texts, own = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *own]
                if len(texts) > 1:
                    yield _table(ids.slice(0, len(ids) - 1), _compared(texts[:-1], own[:-1], texts[1:], own[1:], ranks), WHOLE, part, [None] * (len(texts) - 1))
                held = ids.slice(len(ids) - 1), texts[-1], own[-1]
        if held is not None:
            yield end(LAST, held)

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(pieces(docs, RANGE_BYTES), *order).sortWithinPartitions(*order, "text")
    rows = written(dealt.mapInArrow(scan, f"doc_id {kind}, {_KINDS}, kind int, part long, text string"), "fingerprints")
    return rows.where(F.col("kind") == WHOLE).select("doc_id", *_FOUND).unionAll(_ends(rows, ranks, kind))


def _ends(rows: DataFrame, ranks: np.ndarray, kind: str) -> DataFrame:
    """The last document of each range, with the first of the next range that has any."""
    spark = rows.sparkSession
    parts = sorted(r.part for r in rows.where(F.col("kind") == FIRST).select("part").collect())  # ranges, not documents
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, next long")
    first = rows.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("theirs"))
    last = rows.where(F.col("kind") == LAST).select("doc_id", "part", "text", F.col("fingerprint").alias("own"))

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: ends may be long
                text, own, other, theirs = (batch.column(c)[i].as_py() for c in range(1, 5))
                found = _compared([text], [parsed(own)], [other], [parsed(theirs)], ranks)
                yield pa.RecordBatch.from_arrays(_table(batch.column(0).slice(i, 1), found, WHOLE, 0, [None]).columns[: 1 + len(_FOUND)], ["doc_id", *_FOUND])

    pairs = last.join(following, "part").join(first, "next").select("doc_id", "text", "own", "next_text", "theirs")
    return pairs.mapInArrow(scan, f"doc_id {kind}, {_KINDS}")


def op12_fingerprints(spark, sf_dir) -> DataFrame:
    """Contract columns of whole documents."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", *_FOUND)
