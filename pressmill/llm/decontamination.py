"""Benchmark decontamination by a prefix-filtered set join of word shingles.

A benchmark item is cut into windows of `window` words (a shorter item is one
window). A document word is hit if it lies in an occurrence of some window.

A window that occurs in a document has all its shingles there, so one of them
is a sufficient prefix of its shingle set: the one that is rarest over all
documents. Documents are joined with those prefix shingles only; the shingle's
offset in the window bounds where the window could start and end, and the
words at that place are then compared with the window's.

* One pass reads each document and keeps the stretches whose shingles may all
  be the benchmark's (a bit map tells) and which are long enough for a window.
  Everything after that works on those stretches, cut into pieces.
* Rarity is counted over all documents' stretches. Shingles travel with their
  place only; words are fetched for the pieces that a prefix was found in.

Nulls: a null text has no words; a null item_id can hit, but isn't listed.
Repeated rows each give a row; repeated items count once by item_id.
Empty tables give no rows, or rows without hits. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ALNUM, chunks, shingle_hashes, text_bytes, word_hashes, word_spans, written

WINDOW = 13
SHINGLE = 5
#: Bits for each of the benchmark's words in the map that documents' shingles are tested against, and bits at most (32 MB).
#: A map that is too small for a benchmark lets more stretches through, which the join then looks at: the same result.
BITS_A_WORD, MOST_BITS = 32, 1 << 28
#: Window starts that one emitted stretch answers for; longer stretches are cut.
PIECE = 64

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text) -> F.Column:
    """Array of lower-cased words (empty for null)."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window text, size): each item's windows."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = F.transform(begins, lambda i: F.slice(F.col("words"), i + 1, F.lit(window)))
    return (
        items.select("item_id", F.explode(cut).alias("w"))
        .select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("size"))
        .distinct()
    )


def _shingles(words, k):
    """Array of (position, shingle text)."""
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - k),
        lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, k), " ").alias("shingle")),
    )


def _filter(benchmark: DataFrame, sizes: dict[int, int]) -> np.ndarray:
    """Bit map of the hashes of the benchmark's shingles, of every size in use."""
    words = benchmark.agg(F.sum(F.size(words_of(F.col("text"))))).head()[0] or 0
    size = 1 << max(16, min(MOST_BITS.bit_length() - 1, (BITS_A_WORD * words * max(1, len(sizes))).bit_length()))

    def slots(batches):
        for batch in batches:
            for lo, hi in chunks(np.ones(batch.num_rows), 1000):
                buf, starts, ends, first = word_spans(text_bytes(batch.column(0)[lo:hi]), ALNUM)
                hashes = word_hashes(buf, starts, ends)
                found = [np.empty(0, np.uint64)]
                for a, b in zip(first[:-1], first[1:], strict=True):
                    found += [shingle_hashes(hashes[a:b], k) for k in sizes]
                bits = np.unique(np.concatenate(found) % np.uint64(size)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.int64(1) << (bits & 63))], ["slot", "bits"])

    rows = benchmark.select("text").mapInArrow(slots, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)  # at most this many rows come
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def _stretches(docs: DataFrame, bits, sizes: dict[int, int], window: int) -> DataFrame:
    """(uid, doc_id, n_words, stretches): each document with the places that may hold windows."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"_uid long, doc_id {id_type}, n_words long, stretches array<struct<start:int, own:int, words:array<string>>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("own", pa.int32()), ("words", pa.list_(pa.string()))]))

    def scan(batches):
        table = np.asarray(bits.value)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for lo, hi in chunks(np.fromiter(map(len, texts), np.int64, len(texts))):
                part = batch.slice(lo, hi - lo)
                buf, starts, ends, first = word_spans(texts[lo:hi], ALNUM)
                hashes = word_hashes(buf, starts, ends)
                last = np.repeat(first[1:], np.diff(first))  # where each word's document ends
                covered = np.zeros(len(hashes) + 1, np.int32)
                for k, least in sizes.items():
                    h = shingle_hashes(hashes, k) % np.uint64(8 * len(table))
                    hit = (table[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1
                    at = np.arange(len(h))
                    hit = (hit > 0) & (at + k <= last[: len(h)])
                    where = np.flatnonzero(hit)
                    if not len(where):
                        continue
                    cut = np.flatnonzero((np.diff(where) != 1) | (last[where[1:]] != last[where[:-1]])) + 1
                    for a, b in zip(np.r_[0, cut], np.r_[cut, len(where)], strict=True):
                        if b - a + k - 1 >= least:
                            covered[where[a]] += 1
                            covered[where[b - 1] + k] -= 1
                found: list[list] = [[] for _ in range(hi - lo)]
                inside = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
                if len(inside):
                    cut = np.flatnonzero((np.diff(inside) != 1) | (last[inside[1:]] != last[inside[:-1]])) + 1
                    data = buf.tobytes()
                    for a, b in zip(inside[np.r_[0, cut]].tolist(), (inside[np.r_[cut, len(inside)] - 1] + 1).tolist(), strict=True):
                        doc = int(np.searchsorted(first, a, "right")) - 1
                        for p in range(a, b, PIECE):
                            upto = min(b, p + PIECE + window - 1)
                            words = [data[starts[i] : ends[i]].decode() for i in range(p, upto)]
                            found[doc].append({"start": p - int(first[doc]), "own": min(PIECE, b - p), "words": words})
                n_words = pa.array(np.diff(first).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("_uid"), part.column("doc_id"), n_words, pa.array(found, kind)], ["_uid", "doc_id", "n_words", "stretches"])

    return docs.mapInArrow(scan, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, uid: str | None = None) -> DataFrame:
    """Per row of docs: _uid, doc_id, n_words, n_hit, item_ids (sorted array), hits (spans).

    uid: the column of docs that numbers its rows; else rows are numbered here, where they are read once.
    """
    spark = docs.sparkSession
    number = F.col(uid) if uid else F.monotonically_increasing_id()
    docs = docs.select("doc_id", "text", number.alias("_uid"))
    windows = written(benchmark_windows(benchmark, window), "windows")
    k_of = F.least(F.col("size"), F.lit(shingle))
    # size of shingle: shortest window with that size (at most `shingle` entries)
    sizes = {int(r.k): int(r.least) for r in windows.groupBy(k_of.alias("k")).agg(F.min("size").alias("least")).collect()}
    bits = spark.sparkContext.broadcast(_filter(benchmark, sizes))
    base = written(_stretches(docs, bits, sizes, window), "stretches")

    pieces = base.select("_uid", F.explode("stretches").alias("s")).select("_uid", "s.*")
    place = ["_uid", "start", "own", "n"]
    by_size = [
        pieces.where(F.size("words") >= k).select("_uid", "start", "own", F.size("words").alias("n"), F.explode(_shingles(F.col("words"), F.lit(k))).alias("g")).select(*place, "g.at", "g.shingle", F.lit(k).alias("k"))
        for k in sizes
    ] or [pieces.select("_uid", "start", "own", F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit("").alias("shingle"), F.lit(0).alias("k")).where("false")]
    there = by_size[0]
    for more in by_size[1:]:
        there = there.unionByName(more)

    # rarity over all documents, then each window's rarest shingle
    rarity = there.where("at < own").groupBy("shingle").agg(F.count("*").alias("n"))
    distinct = windows.select("window", "size").distinct()
    parts = distinct.withColumn("w", F.split("window", " ")).select("window", "size", F.explode(_shingles(F.col("w"), k_of)).alias("g")).select("window", "size", "g.at", "g.shingle")
    rarest = F.min(F.struct("n", "shingle", F.col("at").alias("offset"))).alias("p")
    prefix = parts.join(rarity, "shingle").groupBy("window", "size").agg(rarest, F.count("*").alias("found"))
    # a window with a shingle that occurs nowhere can't occur either
    prefix = prefix.where(F.col("found") == F.col("size") - k_of + 1).select("window", "size", "p.shingle", "p.offset")

    begin = F.col("at") - F.col("offset")
    same = F.array_join(F.slice("words", F.col("begin") + 1, F.col("size")), " ") == F.col("window")
    found = (
        there.join(prefix, "shingle")
        .where((F.col("k") == k_of) & (begin >= 0) & (begin < F.col("own")) & (begin + F.col("size") <= F.col("n")))
        .select("_uid", "start", begin.alias("begin"), "size", "window")
    )
    hits = found.join(pieces.select("_uid", "start", "words"), ["_uid", "start"]).where(same).select("_uid", (F.col("start") + F.col("begin")).alias("begin"), "size", "window")
    hits = written(hits, "hits")
    spans = hits.select("_uid", F.struct("begin", (F.col("begin") + F.col("size")).alias("end")).alias("span")).distinct()
    items = hits.select("_uid", "window").distinct().join(windows.select("window", F.col("item_id").cast("string").alias("item")), "window").select("_uid", "item").distinct()

    none = {"span": F.lit(None).cast("struct<begin:int,end:int>"), "item": F.lit(None).cast("string")}
    rows = base.select("_uid", "doc_id", "n_words").withColumns(none).unionByName(spans, allowMissingColumns=True).unionByName(items, allowMissingColumns=True)
    grouped = rows.groupBy("_uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sort_array(F.collect_list("span")).alias("hits"), F.sort_array(F.collect_list("item")).alias("item_ids"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["begin"], a["upto"]), F.lit(0))).alias("n"), F.greatest(s["end"], a["upto"]).alias("upto")),
        lambda a: a["n"],
    )
    return grouped.select("_uid", "doc_id", "n_words", covered.alias("n_hit"), "item_ids", "hits")


def contaminated(n_hit=None, n_words=None):
    """A document is contaminated if a twentieth or more of its words are hit."""
    n_hit, n_words = F.col("n_hit") if n_hit is None else n_hit, F.col("n_words") if n_words is None else n_words
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op1_decontamination(spark, sf_dir) -> DataFrame:
    """Contract columns of contamination() over whole documents and benchmark."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i)
  WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM win
), grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, item_id, i, size FROM grams JOIN win USING (size, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
