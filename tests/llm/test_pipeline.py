from pyspark.sql import functions as F

import corpus_pipeline as cp
from pressmill.llm import decontamination, pii, simhash
from pressmill.llm import quality_classifier as qc
from pressmill.llm._shared import numbered, written

from .test_decontamination import brute
from .test_duplicates import near, plain_print


def test_stages_one_by_one(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = []
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, tables), "test")
        kept.append((name, docs, out))
        docs = out
    assert len(cp.STAGES) == 5
    assert all(out.columns == docs.columns for _, docs, out in kept[:-1])

    _, before, after = kept[0]
    scorer = qc.train(before)
    good = {r.doc_id for r in before.collect() if scorer.score(r.text or "") >= qc.THRESHOLD}
    assert {r.doc_id for r in after.collect()} == good

    _, before, after = kept[1]
    prints = {r.doc_id: plain_print(r.text) for r in before.collect()}
    root, least = near(set(prints.values())), {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert {r.doc_id for r in after.collect()} == set(least.values())

    _, before, after = kept[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    clean = {i for i, n, hit, _ in brute([(r.doc_id, r.text) for r in before.collect()], items) if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in after.collect()} == clean < {r.doc_id for r in before.collect()}

    _, before, after = kept[3]
    keyed = pii.Keyed(pii.choose_key(before, pii.configured_key(spark)))
    put = lambda t: pii.rewritten(t, lambda k, f, e, c: f + pii._spelled(k, keyed.surrogate(k, c), e))
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: put(r.text or "") for r in before.collect()}

    _, before, after = kept[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    import sentencepiece

    from pressmill.llm.sentencepiece_codec import default_model

    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for r in after.collect():
        assert list(r.ids) == [*library.encode(texts[r.doc_id]), 2] and r.text == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_odd_rows(spark, odd, none, tables):
    for frame, rows in ((odd, 9), (none, 0)):
        docs = written(frame.withColumns({"n_entities": F.lit("clash"), "row": F.lit("clash")}), "test")
        for name, stage in cp.STAGES:
            out = stage(spark, docs, tables)
            assert out.count() <= rows
            if name != cp.STAGES[-1][0]:  # clashing columns keep their values
                assert out.columns == docs.columns
                assert all({r[c] for r in out.collect()} <= {"clash"} for c in docs.columns[5:]), name
    left = cp.near_duplicates(spark, written(odd, "test"), tables).collect()
    empty, numbers = (sum(not (r.text or "").split() for r in left), sum((r.text or "").startswith("one") for r in left))
    assert empty == numbers == 1  # of repeated rows, too, one stays
    assert len(left) == 4


def test_row_numbers_outlive_a_second_reading(spark, odd):
    rows, name = numbered(odd.repartition(3).coalesce(2))
    assert name == "_uid_" and {r._uid for r in rows.collect()} == {"clash"}
    again = {(r[name], str(r.text)) for r in rows.collect()}
    assert len(again) == odd.count() == rows.join(rows.select(name), name).count() and again == {(r[name], str(r.text)) for r in rows.collect()}


def test_run(spark, tables):
    assert cp.run(spark, tables).count() > 0
    assert decontamination.WINDOW == 13 and simhash.DISTANCE == 3
