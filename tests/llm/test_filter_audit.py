import re
from itertools import permutations

from pyspark.sql import functions as F

from pressmill.llm import filter_audit as fa
from pressmill.llm.queries import oracle_sql, queries

from ..oracle import same


def test_equals_sql(spark, tables):
    same(queries()["op11_filter_audit"](spark, tables), tables, oracle_sql()["op11_filter_audit"])


def replayed(docs, labels):
    """Every order, filter by filter, over a list of (doc_id, text, lang)."""
    marks = {}
    for i, quality, toxic in labels:
        if i is not None:
            good, bad = marks.get(i, (False, False))
            marks[i] = (good or quality == 1, bad or toxic == 1)
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        rows.append((lang or "", {f for f in fails if fails[f]}, *marks.get(i, (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                failing = [r for r in rows if r[0] == part and f in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_odd_rows(spark, odd, none, long_text):
    labels = [(1, None, None), (2, 1, 0), (2, 0, 1), (4, 1, 1), (None, 1, 1), (7, None, 1), (77, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("clash"))
    prose = " ".join(f"word{i}" for i in range(120))
    more = [(7, long_text, "en"), (8, prose, "en"), (9, prose, ""), (9, prose, None), (10, prose + " #", "de"), (11, prose.upper(), "de"), (12, prose.replace("word1", "Word9"), "de"), (-3, prose, "fr"), (None, prose, "fr")]
    docs = odd.select("doc_id", "text", "lang", "_uid", "key").unionAll(spark.createDataFrame([(*r, "x", "y") for r in more], "doc_id bigint, text string, lang string, _uid string, key string"))
    docs = docs.withColumns({c: F.lit("clash") for c in ("A", "e", "n", "part", "digest", "first", "share")}).repartition(5)
    plain = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = replayed(plain, labels)
    assert found(fa.audit(docs, marks)) == want and len(want) == 600 * len({p for p, _, _ in want})
    assert fa.audit(none, marks).count() == 0
    assert found(fa.audit(docs, marks.where("false"))) == replayed(plain, [])


def test_flags_at_their_bounds():
    words = [f"w{i}".encode() for i in range(80)]
    assert fa.judged(b" ".join(words * 2)[:0]) == (True, False, False, False)
    assert not fa.judged(b"\t".join(words + words[:20]))[1] and fa.judged(b"\x0b".join(words + words[:21]))[1]  # 80 of 100, 80 of 101
    assert not fa.judged("Aééééééééé".encode())[2] and fa.judged("Aéééééééé".encode())[2]  # one of ten, one of nine code points
    assert [fa.judged(x)[3] for x in (b"a|", b"&", b"<>", "＃".encode())] == [True, True, False, False]
    assert not fa.judged("a b".encode() * 99)[0] is False  # a no-break space parts no words


def test_the_cube_does_the_counting(spark, odd):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    plan = fa.survivors(fa.cells(odd, labels))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in plan
    assert "CartesianProduct" not in fa.audit(odd, labels)._jdf.queryExecution().executedPlan().toString()
