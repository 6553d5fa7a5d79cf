"""Submitted publishers: validation, answers of a moderator, and what an approval writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, site, verdict
from ..functions.urls import is_url

REQUIRED = ["name", "homepage_url", "feed_url", "country_iso", "language"]


def requests(documents: DataFrame, body: str = "body") -> DataFrame:
    """documents with the fields of their JSON bodies; one without a body, or that is no object, has none of them."""
    fields = F.from_json(F.coalesce(F.col(body), F.lit("{}")), ", ".join(f"{c} string" for c in [*REQUIRED, "contact_email"]))
    return documents.select("*", *[fields[c].alias(c) for c in [*REQUIRED, "contact_email"]])


def validated(bodies: DataFrame, countries: DataFrame) -> DataFrame:
    """bodies with country_id and error: null, or why the submission is refused."""
    missing = F.array_join(F.filter(F.array(*[F.when(filled(F.col(c)).isNull(), F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull()), ", ")
    known = countries.select(F.col("id").alias("country_id"), F.col("iso_code").alias("_iso"))
    joined = bodies.join(F.broadcast(known), F.upper("country_iso") == F.col("_iso"), "left").drop("_iso")
    return joined.withColumn(
        "error",
        F.when(missing != "", F.concat(F.lit("missing: "), missing))
        .when(~is_url(F.col("homepage_url")) | ~is_url(F.col("feed_url")), "not a URL")
        .when(F.col("country_id").isNull(), "unknown country"),
    )


def already_known(urls: DataFrame, feeds: DataFrame, submissions: DataFrame) -> DataFrame:
    """Those of urls(feed_url) that are a feed, or pending."""
    known = feeds.select("feed_url").unionAll(submissions.where("status = 'pending'").select("feed_url"))
    return urls.join(known, "feed_url", "left_semi")


def pending(submissions: DataFrame, countries: DataFrame) -> DataFrame:
    c = countries.select(F.col("id").alias("country_id"), F.col("name").alias("country_name"), "iso_code")
    return submissions.where("status = 'pending'").join(F.broadcast(c), "country_id").orderBy(F.asc_nulls_last("submitted_at"), "id")


def decisions(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, status, note): lines of answers(line_no, text) dealt to the queue(id, place).

    Each submission takes a line; one that is rejected takes the next as its note. The fold
    over one moderator's lines is a running parity: a line is an answer if it isn't the note
    of the one before.
    """
    lines = answers.select(F.col("line_no").alias("n"), F.coalesce("text", F.lit("")).alias("t"))
    # which lines are notes: in a run of lines that reject, every second one is a note
    order = Window.orderBy("n")
    rejects = verdict(F.col("t")).eqNullSafe("rejected")
    runs = lines.withColumn("r", rejects).withColumn("g", F.sum(F.when(~rejects, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    placed = runs.withColumn("k", F.row_number().over(Window.partitionBy(F.coalesce("g", F.lit(0))).orderBy("n")))
    noted = placed.withColumn("is_note", F.col("k") % 2 == 0).withColumn("note", F.lead("t").over(order))
    dealt = noted.where(~F.col("is_note")).withColumn("place", F.row_number().over(order))
    joined = queue.join(dealt, "place")
    note = F.when(verdict(F.col("t")) == "rejected", filled(F.col("note")))
    return joined.select("id", verdict(F.col("t")).alias("status"), note.alias("note")).where(F.col("status").isNotNull())


def reviewed(submissions: DataFrame, decided: DataFrame, now: Column) -> DataFrame:
    """submissions after decisions."""
    d = decided.select("id", F.col("status").alias("_s"), F.col("note").alias("_n"))
    hit = F.col("_s").isNotNull()
    return (
        submissions.join(d, "id", "left")
        .withColumns(
            {
                "status": F.coalesce("_s", "status"),
                "reviewed_at": F.when(hit, now).otherwise(F.col("reviewed_at")),
                "reviewer_note": F.when(F.col("_s") == "rejected", F.col("_n")).otherwise(F.col("reviewer_note")),
            }
        )
        .select(submissions.columns)
    )


def approved_publishers(submissions: DataFrame) -> DataFrame:
    """Publisher rows of approved submissions: the domain is what the homepage's address says."""
    ok = submissions.where("status = 'approved'")
    return ok.select("country_id", "name", "homepage_url", site(F.col("homepage_url")).alias("domain"), F.lit("active").alias("feed_status"), "language", "feed_url", "feed_type")
