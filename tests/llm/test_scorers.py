import random

import numpy as np
from pyspark.sql import functions as F

from pressmill.llm import quality_classifier as qc
from pressmill.llm import quality_rules as qr
from pressmill.llm import toxicity as tx
from pressmill.llm.queries import oracle_sql, queries

from ..oracle import same


def test_rules_equal_sql(spark, tables):
    same(queries()["op9_quality_rules"](spark, tables), tables, oracle_sql()["op9_quality_rules"])


def test_ablations_equal_sql(spark, tables):
    same(queries()["quality_rule_ablations"](spark, tables), tables, oracle_sql()["quality_rule_ablations"])


def brute_rules(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_measures(spark, odd, none):
    texts = ["a b c a b c", "a a a a", "a b c d", "x\nx\n\nx\n x", "| # $\n%", "a\x0bb\x85c\xa0d", "a b a b a b", None, "", "\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for frame in (df, odd):
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.ledger(frame).collect()), key=str)
        assert got == sorted(((r.doc_id, *brute_rules(r.text)) for r in frame.collect()), key=str)
    assert qr.ledger(none).count() == 0


def test_no_python_in_the_ledger(spark, odd):
    plan = qr.ledger(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_policies_and_ablations(spark, tables):
    rows = qr.ledger(spark.read.parquet(f"{tables}/documents.parquet"))
    failed = [r.failed for r in rows.select("failed").collect()]
    for policy, names in qr.POLICIES.items():
        own = qr.mask(policy)
        got = {r.rule: (r.failed, r.failed_alone, r.kept_without) for r in qr.ablations(rows, policy).collect()}
        assert got == {
            n: (sum(f & qr.BIT[n] > 0 for f in failed), sum(f & own == qr.BIT[n] for f in failed), sum(f & own & ~qr.BIT[n] == 0 for f in failed)) for n in names
        }


def test_weak_labels_find_the_good_class():
    rng = np.random.default_rng(0)
    k, n = len(qc.LABELLERS), 4000
    good = rng.random(n) < 0.8
    rate = np.linspace(0.7, 0.95, k)
    votes = np.where(rng.random((n, k)) < 0.3, qc.NOTHING, np.where(rng.random((n, k)) < rate, good[:, None], ~good[:, None]))
    patterns, counts = np.unique(votes @ 3 ** np.arange(k - 1, -1, -1), return_counts=True)
    posterior = dict(zip(patterns, qc.estimate(patterns, counts.astype(float))))
    called = np.array([posterior[p] > 0.5 for p in votes @ 3 ** np.arange(k - 1, -1, -1)])
    assert (called == good).mean() > 0.95


def test_quality_of_labelled_documents(spark):
    tables = "/root/testdata/sf0.01"
    got = qc.op8_quality_classifier(spark, tables).join(spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    good, junk = [r.kept for r in got if r.label == 1], [r.kept for r in got if r.label == 0]
    assert np.mean(good) > 0.97 and np.mean(junk) < 0.2


def test_quality_of_odd_rows(spark, odd, none):
    scorer = qc.train(odd)
    out = qc.score(odd, scorer).collect()
    assert len(out) == odd.count() and all(0 <= r.quality <= 1 and r.size == "clash" for r in out)
    assert qc.score(none, qc.train(none)).count() == 0


def test_toxicity_held_out(spark):
    tables = "/root/testdata/sf0.1"
    got = tx.op6_toxicity(spark, tables).join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(hit) > 0.85 and np.mean(clean) < 0.02


def test_pairs_beyond_linear_weights():
    rng = random.Random(0)
    rows = []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((np.array([i for i, x in ((0, a), (1, b), (2, True)) if x]), int(a and b)))
    m = tx.fit(np.arange(3), rows)
    z = lambda *s: m.bias + m.weights[list(s)].sum() + 0.5 * ((m.factors[list(s)].sum(0) ** 2).sum() - (m.factors[list(s)] ** 2).sum())
    assert z(0, 1, 2) > 0 > max(z(0, 2), z(1, 2), z(2))
    assert abs((m.factors[0] * m.factors[1]).sum()) > 0.1  # the pair has a weight of its own


def test_training_keeps_terms_that_only_tell_in_a_pair(spark):
    """Toxic if and only if two words stand together or are both absent; and an insult only beside a group."""
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"filler{rng.randrange(300)}" for _ in range(20)] + ["alpha"] * a + ["omega"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    m = tx.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    score = lambda t: m.score(t)
    assert min(score("alpha omega filler1"), score("filler1 filler2")) > 0.6 > 0.4 > max(score("alpha filler1"), score("omega filler2"))
    rows = []
    for i in range(6000):
        insult, group = rng.random() < 0.1, rng.random() < 0.1
        words = [f"filler{rng.randrange(3000)}" for _ in range(20)] + ["vermin"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and (group or rng.random() < 0.2) or rng.random() < 0.03)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    m = tx.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    among = lambda words: np.mean([score(words + " " + " ".join(f"filler{rng.randrange(3000)}" for _ in range(20))) for _ in range(200)])
    assert among("martians vermin") > 0.6 > 0.4 > max(among("martians"), among("vermin"))
    assert tx.slot("martians") in m.place


def test_scorers_of_a_long_text(spark, long_text):
    df = spark.createDataFrame([(1, long_text), (2, "short")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    assert tx.score(df, tx.train(df, labels)).count() == 2
    assert qc.score(df, qc.train(df)).where("quality BETWEEN 0 AND 1").count() == 2
    r = {x.doc_id: x for x in qr.ledger(df).collect()}
    assert r[1].n_words == 120_000 and r[1].n_repeat_words == 120_000


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 0, 1), (4, 1, 1), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    machine = tx.train(odd, labels)
    assert len([r for r in tx.score(odd, machine).collect() if 0 <= r.score <= 1]) == odd.count()
    assert tx.score(none, tx.train(none, labels.where("false"))).count() == 0
    flags = {r.doc_id: r.h for r in odd.select("doc_id", tx.held_out(F.col("doc_id")).alias("h")).collect()}
    import zlib

    assert flags == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in flags}
