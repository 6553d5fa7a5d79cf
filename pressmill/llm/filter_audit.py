"""Filter interaction audit: what five filters do alone, together, and in every order.

Each text is judged once, in the task that reads it, into five failure flags.
Rows are then counted into cells (part, flags, labels), and one SQL CUBE over the
flags and the part gives, in the rows whose chosen flags are all false, how many
documents each subset of filters leaves. A step of an order takes its numbers from
two such subsets, the one before and the one behind it; no order is replayed.

Only a digest of each text is shuffled. A text that many documents share is counted
before it travels, so no task sees all of its copies. Cells are 2 ** 7 a part at most.

Null and empty texts have no words: they fail A alone, and E as copies of the least
doc_id that has none either. Null langs and empty ones are one part, the empty
string. Repeated rows count each; rows that have their text's least doc_id pass E
together, and a row without doc_id neither precedes a copy nor is one. A document
is good or toxic if some row of labels says so; labels without a doc_id say nothing.
Columns other than doc_id, text and lang are ignored. Long texts are judged whole,
one at a time. An empty table gives no rows. Texts count as identical by SHA-256.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import salt, text_bytes, written

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1

UPPER = bytes(range(0x41, 0x5B))
MARKS = b"#$%&*|"
#: Bytes of UTF-8 that begin no code point.
INNER = bytes(range(0x80, 0xC0))

#: Texts taken out of an Arrow batch at once.
ROWS = 500


def judged(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Flags A to D of one text: few words, repeated words, capitals, marks."""
    words = text.split()  # at ASCII white space, as bytes are
    n = len(words)
    capitals, points = len(text) - len(text.translate(None, UPPER)), len(text.translate(None, INNER))
    return n < 100, 100 * len(set(words)) < 80 * n, 100 * capitals > 10 * points, len(text.translate(None, MARKS)) < len(text)


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, the text's digest and the flags A to D, for each row."""

    def scan(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                texts = text_bytes(some.column(2))
                found = zip(*map(judged, texts), strict=True)
                columns = [some.column(0), some.column(1), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.bool_()) for x in found)], ["doc_id", "part", "digest", *"ABCD"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(scan, f"doc_id {kind}, part string, digest binary, A boolean, B boolean, C boolean, D boolean")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and all five flags: n, and how many of them labels call good and toxic."""
    own = ["digest", "part", *"ABCD"]
    rows = flags(docs).groupBy("doc_id", *own).agg(F.count("*").alias("n"))
    # rows without doc_id have no label and are dealt out by their digests
    share = F.when(F.col("doc_id").isNull(), salt("digest")).otherwise(F.lit(-1).cast("bigint"))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    known = rows.withColumn("share", share).join(said.withColumn("share", F.lit(-1).cast("bigint")), ["doc_id", "share"], "left")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    n = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    texts = known.groupBy(*own, "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"), n(F.sum(F.when(F.col("doc_id").isNull(), F.col("n")))).alias("unnamed")
    )
    texts = written(texts, "texts")  # read twice; a digest has a row for each part and label, however many documents share it
    least = texts.groupBy("digest").agg(F.min("first").alias("least"))
    passing = F.col("unnamed") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(F.lit(0).cast("bigint"))
    split = texts.join(least, "digest").withColumn("passing", passing)
    both = F.array(F.struct(F.lit(False).alias("E"), F.col("passing").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("passing")).alias("n")))
    each = split.select("part", *"ABCD", "good", "toxic", F.explode(both).alias("x")).select("*", "x.E", "x.n").where("n > 0")
    count = lambda c: n(F.sum(F.when(F.col(c), F.col("n")))).alias(c)
    return each.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), count("good"), count("toxic"))


_CHOSEN = " + ".join(f"{1 << i} * (1 - grouping({f}))" for i, f in enumerate(FILTERS))
_FAILS = " OR ".join(f"coalesce({f}, false)" for f in FILTERS)
#: The documents of each part that every chosen filter lets pass, by the bits of the chosen ones.
SURVIVORS = f"""
SELECT part, chosen, n, good, toxic FROM (
  SELECT part, {", ".join(FILTERS)}, CAST({_CHOSEN} AS int) AS chosen, grouping(part) AS whole, sum(n) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM {{cells}} GROUP BY CUBE ({", ".join(FILTERS)}, part)
) WHERE whole = 0 AND NOT ({_FAILS})
"""


def survivors(counted: DataFrame) -> DataFrame:
    """part, chosen (bit i: filter i), n, good, toxic for every subset of the filters; zeros included."""
    left = counted.sparkSession.sql(SURVIVORS, cells=counted)
    every = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("chosen"))
    return every.join(left, ["part", "chosen"], "left").fillna(0, ["n", "good", "toxic"])


def steps(spark: SparkSession) -> DataFrame:
    """The steps of all orders: filter_order, step, filter, and the subsets before and behind it. 600 rows, by the rule."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            after = before | 1 << FILTERS.index(f)
            rows.append(("".join(order), i + 1, f, before, after))
            before = after
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    left = survivors(written(cells(docs, labels), "cells"))  # read often; the texts are read once
    named = lambda tag, *names: left.select("part", F.col("chosen").alias(tag), *[F.col(c).alias(f"{tag}_{c}") for c in names])
    # what a filter does to all documents, and to those that only it takes
    own = spark.createDataFrame([(f, 0, 1 << i, ALL & ~(1 << i), ALL) for i, f in enumerate(FILTERS)], "filter string, none int, alone int, others int, every int")
    single = F.broadcast(own).join(named("none", "n"), "none").join(named("alone", "n"), ["part", "alone"])
    single = single.join(named("others", "n"), ["part", "others"]).join(named("every", "n"), ["part", "every"])
    single = single.select("part", "filter", (F.col("none_n") - F.col("alone_n")).alias("fails"), (F.col("others_n") - F.col("every_n")).alias("unique_fails"))
    pairs = F.broadcast(steps(spark)).join(named("before", "n", "good", "toxic"), "before").join(named("after", "n", "good", "toxic"), ["part", "after"])
    lost = lambda c: F.col(f"before_{c}") - F.col(f"after_{c}")
    walked = pairs.select("part", "filter_order", "step", "filter", F.col("after_n").alias("kept"), lost("n").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    shares = walked.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    found = walked.join(shares.join(single, ["part", "filter"]), ["part", "filter"])
    return found.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark, sf_dir) -> DataFrame:
    """Contract columns: five filters in all orders, over whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT d.doc_id, part, {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
         'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
         'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)} AS x,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || letter FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT contains(o, letter)
), letters AS (
  SELECT o, i, o[i] AS letter FROM (SELECT o, unnest(range(1, 6)) AS i FROM orders WHERE length(o) = 5)
), docs AS (
  SELECT part, good, toxic, concat(CASE WHEN x.A THEN 'A' ELSE '' END, CASE WHEN x.B THEN 'B' ELSE '' END, CASE WHEN x.C THEN 'C' ELSE '' END, CASE WHEN x.D THEN 'D' ELSE '' END, CASE WHEN x.E THEN 'E' ELSE '' END) AS failed,
         count(*) AS n FROM f GROUP BY ALL
), walked AS (
  SELECT part, o, i, letter, n, good, toxic, failed, contains(failed, letter) AS fails, length(translate(o[1:i - 1], failed, '')) < i - 1 AS gone FROM docs, letters
), counted AS (
  SELECT part, o AS filter_order, CAST(i AS INT) AS step, letter,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed = letter), 0) AS unique_fails,
         coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS toxic_lost
  FROM walked GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
