import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.llm import sentencepiece_codec as sp
from pressmill.llm import token_files as tf
from pressmill.llm._shared import new_path


@pytest.fixture(scope="module")
def model():
    with open(sp.default_model(), "rb") as f:
        return sp.PieceModel(f.read())


def odd_texts(n=4000, seed=3):
    rng = random.Random(seed)
    letters = "  ab theing\n\t\r▁　\xa0éß😀ﬀaAtion.,'sS1①\x00\x1c\x85"
    return ["", " ", "▁", "<s>a</s>", "<0x41>", "<|endoftext|>", "a" * 3000, " " * 50] + ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(n)]


def test_pieces_equal_the_library(model):
    for t in odd_texts():
        ids = np.frombuffer(model.encode(t), np.int32).tolist()
        assert ids == [*model.library.encode(t), 2]
        assert model.decode(ids) == model.library.decode(ids)


def test_decode_of_any_ids(model):
    rng = random.Random(1)
    for _ in range(500):
        ids = [rng.randrange(3, 600) for _ in range(rng.randrange(6))]
        assert model.decode(ids) == model.library.decode(ids)


def test_backtracking_is_needed_and_bounded(model):
    text = "▁" + "ab" * 4000
    assert model.search(text) == model.library.encode("ab" * 4000)


def test_compatibility(model):
    known = model.id_of
    assert not model.compatible(known["t"], known["h"])  # they merge
    assert model.compatible(-1, known["the"])


def test_encode_frames(spark, odd, none):
    model = sp.read_model(spark, sp.default_model())
    out = sp.encode(odd, model, decoded="back").collect()
    library = sp.PieceModel(model.value).library
    assert len(out) == odd.count()
    for r in out:
        assert r.ids == [*library.encode(r.text or ""), 2] and r.back == library.decode(r.ids) and r.size == "clash"
    assert sp.encode(none, model).count() == 0
    again = sp.decode(sp.encode(odd, model), model, text="again").collect()
    assert all(r.again == library.decode(r.ids) for r in again)


def test_words_equal_the_library(spark):
    encoder = tf.TextEncoder(tf.default_tokenizer(spark).value)
    for t in odd_texts():
        assert np.frombuffer(encoder.encode(t), np.uint32).tolist() == encoder.library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("ranks", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(1000))])
def test_pack(ranks):
    controls, data = tf.pack(np.array(ranks, np.uint32))
    assert len(controls) == -(-len(ranks) // 4)
    assert tf.unpack(controls, data, len(ranks)).tolist() == ranks


def files_of(spark, docs):
    path = new_path(spark, "tokens")
    return tf.read_tokens(tf.write_tokens(docs, tf.default_tokenizer(spark), path), path)


def test_round_trip(spark, tables, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 5000)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    encoder = tf.TextEncoder(tf.default_tokenizer(spark).value)
    got = {r.doc_id: r for r in files_of(spark, docs).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*encoder.library.encode(r.text or "", add_special_tokens=False).ids, 0]
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, np.frombuffer(g.ids, "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    assert not got


def test_odd_rows(spark, odd, none):
    rows = files_of(spark, odd).select("doc_id", "start", "n_tokens").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 4, 5, 6]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert files_of(spark, none).count() == 0


def test_query_columns(spark, tables):
    r = tf.op10_token_files(spark, tables).agg(F.count("*").alias("n"), F.min("start").alias("s")).head()
    assert r.n == spark.read.parquet(f"{tables}/documents.parquet").count() and r.s == 0
    assert sp.op2_sentencepiece(spark, tables).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_added_tokens_as_the_library_has_them():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    fresh = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = tf.TextEncoder(f.read())
    for text in ("<|endoftext|>", "one <|endoftext|> two", "a<|endoftext|>b\n\n  c", "<|endoftext|><|endoftext|> x", "no <|endof text|>", "plain words.  Two\tgaps"):
        want = fresh.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == want
        assert (50256 in want) == ("<|endoftext|>" in text)


def test_files_hold_the_doc_ids(spark, odd, long_text, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 100)
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame([(7, long_text)], "doc_id bigint, text string"))
    path = new_path(spark, "tokens")
    manifest = tf.write_tokens(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), tf.default_tokenizer(spark), path)
    assert manifest.columns == ["part", "file", "n_docs", "n_ids"] and manifest.agg(F.sum("n_docs")).head()[0] == 10
    rows = tf.read_tokens(manifest, path, "string").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, "d1", "d2", "d2", "d3", "d4", "d4", "d5", "d6", "d7"]
    encoder = tf.TextEncoder(tf.default_tokenizer(spark).value)
    assert rows[-1].ids[:-4] == encoder.whole(long_text)


def test_long_text_in_pieces(spark, long_text, model):
    df = spark.createDataFrame([(1, long_text)], "doc_id bigint, text string")
    (r,) = sp.encode(df, sp.read_model(spark, sp.default_model()), decoded="back").collect()
    assert r.ids == [*model.library.encode(long_text), 2] and r.back == long_text
