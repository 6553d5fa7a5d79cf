import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.llm import fingerprints as fp
from pressmill.llm.queries import queries

W, M = fp.WINDOW, (1 << 64) - 1


def entropy(window):
    total = sum(round(c * math.log2(c) * 1024) for c in Counter(window).values())
    most = round(len(window) * math.log2(len(window)) * 1024)
    return (most - total) * 1000 // most


def windows(text):
    return [text[i : i + W] for i in range(len(text) - W + 1)] if len(text) >= fp.LONG_FROM else []


def mixed(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * by & M
    return x


def hashed(window):
    h = len(window)
    for i in range(0, len(window), 8):
        h = mixed(h + int.from_bytes(window[i : i + 8], "little") & M)
    return h


def plain_ranks(texts):
    seen = Counter(entropy(w) for t in texts for w in windows(t))
    return {e: i for i, e in enumerate(sorted(range(1001), key=lambda e: (seen[e], e)))}


def plain_digest(text, ranks):
    if len(text) < fp.SHORT:
        found = [int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")] if text else []
    else:
        found = [hashed(text[i : i + fp.SHORT]) for i in range(len(text) - fp.SHORT + 1)] if len(text) < fp.SHORT_BELOW else []
        rank = [ranks[entropy(w)] for w in windows(text)]
        votes = Counter(min(range(r, r + fp.RUN), key=lambda i: (rank[i], i)) for r in range(len(rank) - fp.RUN + 1))
        if votes:
            asked = min(max(votes.values()), min(max(len(rank) // fp.RUN, 1), fp.VOTES))
            found += [hashed(text[i : i + W]) for i in sorted(votes) if votes[i] >= asked]
    found = list(dict.fromkeys(found))
    filters = []
    for j in range(0, len(found), fp.PER_FILTER):
        on = {h >> 11 * i & 2047 for h in found[j : j + fp.PER_FILTER] for i in range(5)}
        filters.append(on)
    return len(found), filters


def packed(digest):
    return f"{digest[0]}:" + base64.b64encode(b"".join(bytes(sum(128 >> b for b in range(8) if 8 * i + b in on) for i in range(256)) for on in digest[1])).decode()


def plain_likeness(a, b):
    if packed(a) == packed(b):
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    x, y = sorted((a, b), key=lambda d: (len(d[1]), d[0], fp.parsed(packed(d))[1]))
    total = 0
    for i, f in enumerate(x[1]):
        best = 0
        for g in y[1]:
            chance, most = len(f) * len(g) / 2048, min(len(f), len(g))
            spread = math.sqrt(chance * (2048 - len(f)) * (2048 - len(g)) / (2048 * 2047))
            floor = chance + max(0.1 * (most - chance), 4 * spread)
            if most > floor:
                best = max(best, (len(f & g) - floor) / (most - floor))
        total += best * min(160, x[0] - 160 * i)
    return total / x[0]


def plain(rows):
    """All contract columns from a list of (doc_id, text); rows of one id in the order that the query takes them."""
    ranks = plain_ranks([t.encode() for _, t in rows])
    prints = [plain_digest(t.encode(), ranks) for _, t in rows]
    out = []
    for i, (doc_id, t) in enumerate(rows):
        j = (i + 1) % len(rows)
        edited = t[: len(t) - len(t) // 3] + rows[j][1][: len(t) // 3]
        changed = plain_digest(edited.encode(), ranks)
        near = (round(plain_likeness(prints[i], changed), 9), round(plain_likeness(prints[i], prints[j]), 9))
        out.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), packed(prints[i]), packed(changed), *near))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def in_order(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return [(r.doc_id, r.text) for r in df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text").collect()]


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "Beta,", "gamma", "été", "日本語", "😀", "of", "the", "a", f"x{rng.randrange(99)}"]) for _ in range(n))


def test_equals_plain_python(spark, odd, none):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 5, 20, 45, 70, 300, 900]))) for i in range(70)]
    rows += [(100, "a" * 700), (101, "ab" * 400), (102, rows[60][1]), (103, rows[60][1]), (103, rows[60][1]), (103, "other"), (None, rows[61][1]), (None, None), (104, "x" * 7), (105, "x" * 8)]
    rows += [(110 + k, prose(rng, 90).encode()[:n].decode(errors="ignore")) for k, n in enumerate((31, 32, 191, 192, 195, 287, 288, 300))]
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("part", "kind", "fingerprint", "n_chars")}).repartition(3)
    assert found(fp.fingerprints(df)) == plain(in_order(spark, rows))
    assert fp.fingerprints(none).count() == 0
    one = [(5, prose(rng, 200))]
    assert found(fp.fingerprints(spark.createDataFrame(one, "doc_id bigint, text string"))) == plain(one)


def test_segments_and_chunks_change_nothing(monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, n).encode() for n in (0, 3, 4000, 30, 700, 1)]
    ranks = np.random.default_rng(1).permutation(fp.RANKS).astype(np.uint32)
    table = dict(enumerate(ranks.tolist()))
    want = [packed(plain_digest(t, table)) for t in texts]
    for size in (fp.SEGMENT, 1000, 64):
        monkeypatch.setattr(fp, "SEGMENT", size)
        for chunk in (fp.CHUNK_BYTES, 500):
            monkeypatch.setattr(fp, "CHUNK_BYTES", chunk)
            assert [fp.shown(d) for d in fp.digests(texts, ranks)] == want
    joined = b"".join(texts)
    assert fp.entropies(np.frombuffer(joined, np.uint8)).tolist() == [entropy(joined[i : i + W]) for i in range(len(joined) - W + 1)]


def test_edits_are_alike_and_strangers_are_not(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = queries()["op12_fingerprints"](spark, tables).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and {r.doc_id for r in rows} == set(texts)
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    words = lambda i: set(zip(*[texts[i].split()[k:] for k in range(5)], strict=False))
    strangers = [r for r in rows if not words(r.doc_id) & words(after[r.doc_id])]
    assert len(strangers) > 100 and max(r.near_next for r in strangers) < 0.1
    long = [r for r in rows if r.n_chars >= 100]
    assert min(r.near_edited for r in long) > 0.25 and sum(r.near_edited for r in long) / len(long) > 0.6
    same = {}
    for r in rows:
        assert same.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


@pytest.mark.parametrize("edit", ["head", "middle", "insert"])
def test_edits_elsewhere(spark, tables, edit):
    """Words are replaced at the beginning, in the middle, or put in: the digest stays like the text's own."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").where(F.length("text").between(1000, 9000)).limit(40)
    words = F.split("text", " ")
    n = F.size(words)
    new = F.array_repeat(F.lit("zzyzx"), 30)
    put = {"head": F.concat(new, F.slice(words, 31, n)), "middle": F.concat(F.slice(words, 1, F.lit(60)), new, F.slice(words, 91, n)), "insert": F.concat(F.slice(words, 1, F.lit(60)), new, F.slice(words, 61, n))}[edit]
    ranks = fp.rarity(docs)
    both = fp.digested(fp.digested(docs.withColumn("old", F.col("text")), ranks).withColumn("text", F.array_join(put, " ")), ranks, "changed").collect()
    near = [fp.likeness(fp.parsed(r.fingerprint), fp.parsed(r.changed)) for r in both]
    assert min(near) > 0.3 and sum(near) / len(near) > 0.6
