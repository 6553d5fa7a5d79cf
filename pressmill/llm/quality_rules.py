"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once for each document and stores the
measurements and one bit for each rule that it fails. Policies are versioned
sets of rules, that is masks: applying one, changing one, or asking what a rule
does on its own are bit operations on the stored ledger, without the texts. The
ledger is a Parquet table; the queries read it back and apply a policy to it.

Null and empty texts have no words and no lines; all measurements are zero and
they fail the base rules. Repeated rows and null ids each give a row. Columns
other than doc_id and text are ignored. An empty table gives an empty ledger. A
very long text is measured whole, in one row. Windows of three words count as
equal by a 64-bit hash, so of n windows of a text two different ones are taken
for equal with a chance of n * n / 2 ** 65; ties (equal lines, equal windows) are
what is counted, the first of equal lines is no duplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Rules by bit. A document fails the rule where the condition on its measurements holds.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("upper_case", "10 * n_upper > 4 * word_chars"),
    ("exclamations", "10 * n_exclamations > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versions of the policy: the rules that a kept document must not fail.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "duplicate_lines"],
    "v2": [name for name, _ in RULES],
}
CURRENT = "v2"


def mask(policy: str | list[str]) -> int:
    return sum(BIT[name] for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements that the rules are about."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    one = docs.select(
        "doc_id",
        words.alias("w"),
        lines.alias("lines"),
        F.length(_without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(_without(text, "!"))).cast("long").alias("n_exclamations"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )
    two = one.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        "n_exclamations",
        "n_upper",
        "n_letters",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # a hash of each window of three words
        F.when(F.size("w") < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
        .alias("h"),
    )
    # windows by hash, where some hash occurs twice
    at = F.sequence(F.lit(0), F.size("h") - 1)
    some = F.size(F.array_distinct("h")) < F.size("h")
    three = two.withColumn("by_hash", F.when(some, F.sort_array(F.arrays_zip("h", at.alias("at"))))).drop("h")
    twice = F.filter("by_hash", lambda x, i: (x["h"] == F.get("by_hash", i - 1)["h"]) | (x["h"] == F.get("by_hash", i + 1)["h"]))
    four = three.withColumn("twice", F.sort_array(F.transform(twice, lambda x: x["at"]))).drop("by_hash")
    covered = F.aggregate(
        "twice",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["upto"])).alias("n"), (p + 3).alias("upto")),
        lambda a: a["n"],
    )
    return four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("twice")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failed: bit i is set if rule i fails."""
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs).withColumn("failed", bits)


def fails(policy: str | list[str]) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of docs, evaluated once and written; what follows reads bits and numbers only."""
    return written(ledger(docs), "ledger")


def applied(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger's rows with policy, its version, and kept, its verdict."""
    return rows.withColumns({"policy": F.lit(policy), "kept": ~fails(policy)})


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy, from the ledger: failed, failed_alone (kept but for this rule), and kept without it.

    One aggregate over the ledger's patterns, of which there are 2 ** rules at most.
    """
    own = mask(policy)
    held, n = F.col("held"), F.col("n")
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(own).cast("long")).alias("held")).agg(F.count("*").alias("n"))
    total = lambda hit: F.coalesce(F.sum(F.when(hit, n)), F.lit(0).cast("long"))
    bits = lambda m: held.bitwiseAND(F.lit(m).cast("long"))
    each = [
        F.struct(
            F.lit(name).alias("rule"),
            total(bits(BIT[name]) != 0).alias("failed"),
            total(held == BIT[name]).alias("failed_alone"),
            total(bits(own & ~BIT[name]) == 0).alias("kept_without"),
        )
        for name in POLICIES[policy]
    ]
    return counts.agg(F.array(*each).alias("each")).select(F.explode("each").alias("x")).select("x.*")


def _ledger_of(spark, sf_dir) -> DataFrame:
    return stored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op9_quality_rules(spark, sf_dir) -> DataFrame:
    """Contract columns of the stored ledger of whole documents, under the current policy."""
    rows = applied(_ledger_of(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails("base").alias("base_failed"), "kept", "failed", "policy")


def quality_rule_ablations(spark, sf_dir) -> DataFrame:
    """What each rule of each policy does, from the stored ledger of whole documents."""
    rows, out = _ledger_of(spark, sf_dir), None
    for policy in POLICIES:
        found = ablations(rows, policy).select(F.lit(policy).alias("policy"), "*")
        out = found if out is None else out.unionAll(found)
    return out


_FAILED = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, unnest(i) AS i FROM (SELECT doc_id, list(i) AS i FROM g GROUP BY doc_id, a, b, c HAVING count(*) > 1)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations,
         CAST(length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_upper > 4 * word_chars THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_exclamations > n_words THEN 32 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 128 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 256 ELSE 0 END AS BIGINT) AS failed
  FROM m
)
"""
OP9_SQL = _FAILED + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed, 'v2' AS policy FROM f"

_EACH = ", ".join(f"('{policy}', '{name}', {BIT[name]}, {mask(policy)})" for policy, names in POLICIES.items() for name in names)
ABLATIONS_SQL = f"""{_FAILED}
SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS failed, count(*) FILTER (failed & own = bit) AS failed_alone, count(*) FILTER (failed & (own - bit) = 0) AS kept_without
FROM (VALUES {_EACH}) p(policy, rule, bit, own) LEFT JOIN f ON true GROUP BY policy, rule
"""
