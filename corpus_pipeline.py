"""The corpus pipeline: what a training corpus goes through, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again before the next one. All but the last return the columns of
documents. Rows are told apart by a row number, so repeated doc_ids are
documents of their own.

Null and empty texts go through every stage as the stage's operator says (no
vote, fingerprint zero, no words, no entities, an end id only); null doc_ids
come first where the least of a group is asked for. Columns of the input keep
their names and values, whatever they are called: stages name their own columns
anew. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm import decontamination, pii, quality_classifier, sentencepiece_codec, simhash
from pressmill.llm._shared import fresh, numbered, written
from pressmill.scratch import scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the weakly supervised classifier calls good."""
    name = fresh("quality", docs)
    scored = quality_classifier.score(docs, quality_classifier.train(docs), name)
    return scored.where(F.col(name) >= quality_classifier.THRESHOLD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the least doc_id."""
    rows, uid = numbered(docs)
    named = rows.select(F.struct("doc_id", F.col(uid).alias("row")).alias("doc_id"), "text")
    found = simhash.near_duplicates(named)
    first = found.where("doc_id.row = component_id.row").select(F.col("doc_id.row").alias(uid))
    return rows.join(first, uid, "left_semi").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more belongs to benchmark passages."""
    rows, uid = numbered(docs)
    found = decontamination.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), uid=uid)
    dirty = found.where(decontamination.contaminated()).select(F.col("_uid").alias(uid))
    return rows.join(dirty, uid, "left_anti").select(docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by surrogates; n_chars follows the text."""
    key, moved = pii.prepared(docs, pii.configured_key(spark))
    out = pii.replace(docs, key, fresh("n_entities", docs), fresh("entities", docs), moved).select(docs.columns)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the text that they decode to."""
    model = sentencepiece_codec.read_model(spark, sentencepiece_codec.default_model())
    out = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), model, decoded="decoded")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", private),
    ("SentencePiece encoding and decoding", encoded),
]

#: Training, keyed permutations and encoding have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scope(spark) as keep:  # a stage's own tables go away with it
            docs = keep(written(stage(spark, docs, sf_dir), "stage"))
    return STAGES[-1][1](spark, docs, sf_dir)
