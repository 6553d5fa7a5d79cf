import hashlib
import random
import re

from pressmill.llm import decontamination as d
from pressmill.llm.queries import oracle_sql, queries

from ..oracle import same


def brute(docs, items, window=13):
    def words(t):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    wins = {}
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        found = sorted({str(f) for f in found if f is not None})
        out.append((doc, len(w), len(hit), found))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in df.collect()), key=str)


def test_equals_sql(spark, tables):
    same(queries()["op1_decontamination"](spark, tables), tables, oracle_sql()["op1_decontamination"])


def test_random_texts(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab cd e F".split()) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 12, 13, 14, 20, 30, 0, 8])] + [(None, "e e"), (99, None), (0, "ab ab ab cd")]
    long = " ".join(t for _, t in items if t)
    docs = [(i, text(rng.choice([0, 1, 4, 13, 40, 400]))) for i in range(60)] + [(100, long), (101, long + " zz " + long), (102, " ".join([items[10][1]] * 9))]
    got = d.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows(got) == brute(docs, items)


def test_long_items_only(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(5)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=200)) + " " + items[i % 5][1].upper() + "." + " ".join(rng.choices(vocabulary, k=50))) for i in range(10)]
    docs += [(20, " ".join(items[0][1].split()[:13])), (21, " ".join(items[0][1].split()[:12])), (22, " ".join(x for _, x in items) * 3)]
    got = d.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows(got) == brute(docs, items)


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "two three"), (None, "seven"), (2, None), (3, "")], "item_id bigint, text string")
    want = brute([(r.doc_id, r.text) for r in odd.collect()], [(1, "two three"), (None, "seven")])
    assert rows(d.contamination(odd, items)) == want
    assert d.contamination(none, items).count() == 0
    assert {r.n_hit for r in d.contamination(odd, items.where("false")).collect()} == {0}


def test_long_text(spark, long_text):
    items = [(1, long_text[5000:5300])]
    got = d.contamination(spark.createDataFrame([(1, long_text)], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows(got) == brute([(1, long_text)], items)


def test_rule():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")  # what items_sha256 is where nothing is hit
