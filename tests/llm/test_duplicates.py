import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pressmill.llm import components, simhash, substring_dedup


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(-5, 2000), (7, 7)]
    got = components.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()
    assert {r.node: r.root for r in got} == roots([p for p in pairs if p[0] != p[1]])
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def near(fps, distance=3):
    return roots([(a, a) for a in fps] + [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance])


def check(spark, fps):
    links = simhash.near_links(spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp bigint"))
    got = roots([(a, a) for a in fps] + [(r.u, r.v) for r in links.collect()])
    assert got == near(sorted(set(fps)))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_random_and_near_prints(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 6))) for b in base for _ in range(5)]
    check(spark, [signed(f) for f in fps])


def test_links_in_a_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rng = random.Random(4)
    center = rng.getrandbits(64)
    fps = [center ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)]
    check(spark, [signed(f) for f in fps])


def test_thresholds():
    pairs = np.array([[10.0, 100, 1000]] * 3 + [[1e9, 1e9, 1e9]])
    for parts in (2, 3, 4):
        _, chosen = simhash.allocate(pairs[:parts], [16] * parts, 100)
        assert sum(chosen) == 3 - parts + 1
    assert simhash.allocate(pairs, [16] * 4, 100)[1][3] == -1  # the crowded part is left out
    many = [np.full(4096, 1e8 / 4096)] * 4
    costs = {s: simhash.allocate(simhash.candidate_counts(many[: len(s)], s), s, 10**8) for s in simhash.SHAPES}
    shape = min(costs, key=lambda s: costs[s][0])
    assert len({*costs[shape][1]}) > 1 and len({*shape}) > 1 and costs[shape][0] < costs[16, 16, 16, 16][0] / 5, costs


def test_plan_of_documents(spark):
    """Where candidates weigh more than keys, thresholds are unequal and give fewer candidates than the plain form."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = [r.fp for r in simhash.fingerprints(docs).select("fp").distinct().collect()]
    nodes = spark.createDataFrame([(f,) for f in prints], "fp bigint")

    def candidates(groups, thresholds):
        stored, probes = {}, []
        for r in simhash._key_rows(nodes, groups, thresholds).collect():
            probes.append(((r.key, r.used), r.fp))
            if not r.probe:
                stored.setdefault((r.key, r.used), []).append(r.fp)
        return len({tuple(sorted((f, g))) for key, f in probes for g in stored.get(key, []) if f != g})

    groups, thresholds = simhash.plan(nodes, key_cost=0.0)
    plain = simhash.bit_groups(simhash.bit_likeness(nodes), (16,) * 4)
    assert len({*thresholds}) > 1 and len({*map(len, groups)}) > 1
    assert candidates(groups, thresholds) < candidates(plain, [0] * 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and sum(thresholds) == 4 - len(groups)


def test_any_plan_finds_all_links(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({signed(f) for f in base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4))) for b in base for _ in range(5)]})
    order = rng.sample(range(64), 64)
    for widths, thresholds in (((24, 20, 20), [1, 0, 0]), ((40, 24), [2, 0]), ((32, 32), [1, 1]), ((16,) * 4, [1, -1, 0, 0])):
        ends = np.cumsum(widths)
        groups = [sorted(order[b - w : b]) for b, w in zip(ends.tolist(), widths)]
        monkeypatch.setattr(simhash, "plan", lambda nodes, distance, p=(groups, thresholds): p)
        check(spark, fps)


def test_documents(spark, tables, odd, none):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd):
        rows = [(r.doc_id, plain_print(r.text)) for r in df.collect()]
        root = near({f for _, f in rows})
        least = {}
        for i, f in rows:
            if i is not None:
                least[root[f]] = min(i, least.get(root[f], i))
        want = sorted(((i, f, least[root[f]]) for i, f in rows), key=str)
        assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == want
    assert simhash.near_duplicates(none).count() == 0


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def spans(spark, docs):
    df = spark.createDataFrame([(i, " ".join(w) if w is not None else None) for i, w in docs], "doc_id bigint, text string").repartition(3)
    out = {}
    for r in substring_dedup.repeated_passages(df).collect():
        out.setdefault(r.doc_id, []).append((r.start_word, r.start_word + r.n_words, r.partners))
    return out


def test_passages(spark):
    rng = random.Random(7)
    exact, fuzzy, part = prose(rng, 60), prose(rng, 120), prose(rng, 200)
    edited = [w if rng.random() > 0.08 else "edit" for w in fuzzy]
    docs = [
        (1, prose(rng, 100) + exact + prose(rng, 40)),
        (2, prose(rng, 10) + exact + prose(rng, 400)),
        (3, exact),
        (4, prose(rng, 50) + fuzzy + prose(rng, 50)),
        (5, edited + prose(rng, 70)),
        (6, part[:120] + prose(rng, 50)),
        (7, prose(rng, 30) + part),
        (8, part[70:] + prose(rng, 30)),
        (9, prose(rng, 300)),
        (10, prose(rng, 100) + exact[:30] + prose(rng, 100)),
        (11, []),
        (12, None),
    ]
    got = spans(spark, docs)
    assert got.keys() == {1, 2, 3, 4, 5, 6, 7, 8}
    assert [s[:2] for s in got[1]] == [(100, 160)] and [s[:2] for s in got[2]] == [(10, 70)] and [s[:2] for s in got[3]] == [(0, 60)]
    (a, b, partners), = got[4]
    assert a <= 60 and b >= 160 and partners == [5]
    assert got[7][0][0] == 30 and got[7][-1][1] == 230


def test_edited_passages(spark):
    rng = random.Random(11)
    docs, edits = [], [0.05, 0.1, 0.15, 0.2]
    for i in range(80):
        passage = prose(rng, 60)
        changed = [w for w in passage for w in ([w] if rng.random() > edits[i % 4] * 0.9 else rng.choice([[], ["new"], [w, "more"]]))]
        docs += [(2 * i, prose(rng, rng.randrange(80)) + passage + prose(rng, 60)), (2 * i + 1, prose(rng, 60) + changed + prose(rng, rng.randrange(80)))]
    got = spans(spark, docs)
    found = [all(2 * i + s in got for s in (0, 1)) for i in range(80)]
    by_rate = [sum(found[k::4]) for k in range(4)]
    assert all(n >= least for n, least in zip(by_rate, [20, 20, 19, 14])), by_rate
    assert all(p == [d ^ 1] for d, rows in got.items() for _, _, p in rows)


def test_exact_windows_are_never_missed(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in r.text or "")) for r in docs.collect()}
    where = {}
    for i, w in words.items():
        for k in range(len(w) - 50):
            where.setdefault(" ".join(w[k : k + 51]), set()).add((i, k))
    found = {}
    for r in substring_dedup.repeated_passages(docs).collect():
        found.setdefault(r.doc_id, []).append((r.start_word, r.start_word + r.n_words))
    need = [(i, k) for at in where.values() if len({i for i, _ in at}) > 1 for i, k in at]
    assert need and all(any(a <= k and k + 51 <= b for a, b in found.get(i, [])) for i, k in need)


def test_copies_and_odd_rows(spark, odd, none):
    rng = random.Random(8)
    same = prose(rng, 80)
    got = spans(spark, [(i, same) for i in range(40)])
    assert got.keys() == set(range(40)) and all(s[0][:2] == (0, 80) for s in got.values())
    assert substring_dedup.repeated_passages(odd).count() == 0 and substring_dedup.repeated_passages(none).count() == 0
    long = odd.where("doc_id = 4").withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 20))
    assert substring_dedup.repeated_passages(long).count() == 2  # repeated rows repeat each other


def test_chains():
    anchors = [(0, 100, 5), (7, 107, 6), (15, 114, 5), (16, 300, 5), (300, 110, 5)]
    best = substring_dedup.chains(anchors)
    assert best[0] == anchors[:3] and sorted(map(tuple, (c[0] for c in best[1:]))) == [(16, 300, 5), (300, 110, 5)]


def test_a_chain_joins_what_is_near():
    """A far chain that scores higher doesn't hide the near end."""
    best = substring_dedup.chains([(0, 0, 200), (249, 249, 20), (275, 275, 20)])
    assert [len(c) for c in best] == [1, 2] and best[1] == [(249, 249, 20), (275, 275, 20)]


def test_chains_equal_all_predecessors():
    rng = random.Random(4)
    cost, most = substring_dedup.GAP_COST, substring_dedup.MOST_GAP
    for _ in range(300):
        anchors = sorted({(rng.randrange(300), rng.randrange(300), rng.randrange(5, 30)) for _ in range(rng.randrange(1, 40))})
        score = []
        for a, b, n in anchors:
            gaps = [(score[j], a - aj - nj, b - bj - nj) for j, (aj, bj, nj) in enumerate(anchors[: len(score)]) if 0 <= a - aj - nj <= most and 0 <= b - bj - nj <= most]
            score.append(n + max([s - cost * (p + q) for s, p, q in gaps if s > cost * (p + q)], default=0))
        worth = lambda c: sum(n for _, _, n in c) - cost * sum(q[0] - p[0] - p[2] + q[1] - p[1] - p[2] for p, q in zip(c, c[1:], strict=False))
        found = substring_dedup.chains(anchors)
        assert abs(worth(found[0]) - max(score)) < 1e-9 and sorted(x for c in found for x in c) == anchors
        assert all(max(q[0] - p[0] - p[2], q[1] - p[1] - p[2]) <= most for c in found for p, q in zip(c, c[1:], strict=False))


def test_partial_holders_do_not_stand_between(spark):
    rng = random.Random(5)
    p = prose(rng, 60)
    around = lambda part: prose(rng, 30) + part + prose(rng, 30)
    docs = [(1, around(p)), (2, around(p[:40])), (3, around(p[20:])), (4, around(p))]
    docs += [(5 + i, around(p[i % 12 : i % 12 + 49])) for i in range(24)] + [(40, around(p[5:55])), (41, around(p))]
    for order in (docs, docs[::-1]):
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in order], "doc_id bigint, text string").coalesce(1)
        found = {r.doc_id: r for r in substring_dedup.repeated_passages(df).collect()}
        assert {1, 4, 40, 41} <= found.keys()
        assert all(found[i].start_word <= 30 and found[i].n_words >= 60 for i in (1, 4, 41)), found


def test_neighbours():
    key, doc = np.array([1, 1, 1, 1, 1, 2, 2, 2, 3]), np.array([1, 1, 2, 3, 3, 1, 2, 2, 9])
    i, j, ends = substring_dedup.holders(key, doc)
    assert {*zip(i.tolist(), j.tolist())} == {(0, 2), (1, 2), (2, 3), (4, 2), (5, 6), (7, 5)}
    assert ends.tolist() == [True, True, False] + [True] * 6
    key, doc, at, run = substring_dedup.seeds_of([b"a b " + b"so " * 30 + b"c d e f g h"])
    sizes = run[run != 0]
    assert len(sizes) and sizes.sum() == 0 and sizes.max() == 30 and (np.diff(at) > 0).all()
    behind = substring_dedup.context(key, doc, run, np.flatnonzero(run > 0), 1)
    assert (behind >> np.uint64(56) == 30).any()


def plain_pairs(docs):
    """All pairs of documents, on all their shared runs of five words: who has a passage of whom."""
    rows = [(i, substring_dedup.hashed_words([t.encode()])[0]) for i, t in docs]
    where = {}
    for d, (_, w) in enumerate(rows):
        for k in range(len(w) - 4):
            where.setdefault(tuple(w[k : k + 5].tolist()), []).append((d, k))
    anchors = {}
    for at in where.values():
        for n, (d, k) in enumerate(at):
            for e, m in at[n + 1 :]:
                if d != e:
                    anchors.setdefault((d, e), []).append((k, m))
    out = set()
    for (d, e), links in anchors.items():
        p, q = map(np.array, zip(*links))
        runs = substring_dedup._joined(p, q, np.full(len(p), 5), np.ones(len(p), bool))
        for chain in substring_dedup.chains(list(zip(*(c.tolist() for c in runs[:3])))):
            if substring_dedup.align(rows[d][1], rows[e][1], chain):
                out.add((rows[d][0], rows[e][0]))
                break
    return out


def test_recall_against_all_pairs(spark, monkeypatch):
    """Edited passages among parts of them, with seeds rare and frequent."""
    rng = random.Random(12)
    docs, planted, rates = [], [], (0.0, 0.05, 0.1, 0.15, 0.2)
    for i in range(100):
        passage = prose(rng, 70)
        changed = [w for w in passage for w in ([w] if rng.random() > rates[i % 5] else rng.choice([[], ["new"], [w, "more"]]))]
        for body in (passage, changed):
            docs.append((len(docs), " ".join(prose(rng, 30) + body + prose(rng, 30))))
        planted.append((len(docs) - 2, len(docs) - 1, i % 5))
        for _ in range(6):
            at = rng.randrange(50)
            docs.append((len(docs), " ".join(prose(rng, 40) + passage[at : at + rng.randrange(8, 20)] + prose(rng, 40))))
    true = plain_pairs(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for rare in (16, 3):
        monkeypatch.setattr(substring_dedup, "RARE", rare)
        got = {r.doc_id for r in substring_dedup.repeated_passages(df).collect()}
        for k in range(5):
            own = [(a, b) for a, b, rate in planted if rate == k and (a, b) in true]
            assert len(own) >= 12 and sum(a in got and b in got for a, b in own) >= 0.9 * len(own), (rare, rates[k])
        assert got <= {x for p in true for x in p}


def test_documents_against_all_pairs(spark, tables):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    true = {x for p in plain_pairs(docs) for x in p}
    got = {r.doc_id for r in substring_dedup.op4_substring_dedup(spark, tables).collect()}
    assert got <= true and len(got) >= 0.98 * len(true), true - got


def test_pieces_of_a_passage_around_two_holders(spark):
    rng = random.Random(13)
    p = prose(rng, 80)
    docs = [(i, prose(rng, 20) + (p if i in (14, 29) else p[(at := rng.randrange(68)) : at + 12]) + prose(rng, 20)) for i in range(44)]
    got = spans(spark, docs)
    assert got.keys() == {14, 29} and all((a, b) == (20, 100) for (a, b, _), in got.values())


def test_hot_seed_over_ranges(spark, monkeypatch):
    """A line in all documents; two of them go on alike, wherever ranges of the order are cut."""
    rng = random.Random(14)
    line, more = prose(rng, 12), prose(rng, 60)
    docs = [(i, prose(rng, 30) + line + (more if i in (5, 150) else prose(rng, 60))) for i in range(200)]
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 5000)
    got = spans(spark, docs)
    assert got.keys() == {5, 150} and all(a <= 30 and b == 102 for (a, b, _), in got.values())


def test_long_text(spark, long_text):
    rows = [(1, long_text), (2, "before " + long_text + " after"), (3, "x " * 100_000), (4, "x " * 90_000), (5, "y" * 1_000_000)]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got.keys() == {1, 2, 3, 4} and got[1].n_words == 120_000
    assert got[3].n_different == got[4].n_different == 1 and got[3].n_words >= 90_000 == got[4].n_words  # one word on and on is told as such


def test_words_that_go_on(spark, monkeypatch):
    """Seeds that repeat themselves, rare and frequent, up to the ends of short texts."""
    rng = random.Random(15)
    docs = []
    for i in range(120):
        words = []
        while len(words) < rng.choice([12, 60, 90]):
            words += rng.choice([["so"] * rng.randrange(1, 40), ["a", "b"] * rng.randrange(1, 20), prose(rng, 5, 12)])
        docs.append((i, " ".join(words)))
    tail = " ".join(f"t{i}" for i in range(12))
    docs += [(200, "so " * 45 + tail), (201, "so " * 60 + tail), (202, "u " * 3 + "so " * 52 + tail + " more")]
    true = plain_pairs(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for rare in (16, 2):
        monkeypatch.setattr(substring_dedup, "RARE", rare)
        got = {r.doc_id for r in substring_dedup.repeated_passages(df).collect()}
        known = {x for p in true for x in p}  # chains of other anchors align otherwise, so neither holds the other
        assert {200, 201, 202} <= got and len(got & known) >= 0.9 * len(known), (rare, {200, 201, 202} - got, len(got & known), len(known))


def test_exact_within_less_alike():
    rng = random.Random(8)
    for margin, size in ((40, 60), (100, 60), (100, 50), (70, 120)):
        core = [rng.randrange(1 << 60) for _ in range(size)]
        sides = [[rng.randrange(1 << 60) for _ in range(margin)] for _ in range(2)]
        changed = [[w if i % 5 < 3 else rng.randrange(1 << 60) for i, w in enumerate(s)] for s in sides]
        x, y = (np.array(s[0] + core + s[1], np.uint64) for s in (sides, changed))
        for chain in ([(margin, margin, size)], [(margin + 3, margin + 3, 5), (margin + 20, margin + 20, size - 22)]):
            got = substring_dedup.align(x, y, chain)
            assert any(a <= margin and b >= margin + size and a == c and b == d and alike >= 0.8 for a, b, c, d, alike in got), (margin, size, got)
    gap = substring_dedup._pairs(np.array([1, 2, 3, 4, 9, 5]), np.array([1, 7, 3, 8, 4, 5]))
    assert gap == [(0, 0), (2, 2), (3, 4), (5, 5)]


@pytest.mark.parametrize("rate", [0.07, 0.1])
def test_many_copies_edited_each_on_its_own(spark, rate):
    """All seeds are frequent, and no two texts go on alike: links of all pairs, not of neighbours only."""
    rng = random.Random(21)
    passage = prose(rng, 60)
    docs = []
    for i in range(100):
        changed = [w for w in passage for w in ([w] if rng.random() > rate else rng.choice([[], ["new"], [w, "more"]]))]
        docs.append((i, " ".join(prose(rng, 30) + changed + prose(rng, 30))))
    true = plain_pairs(docs)
    rows = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    pairs = {(r.doc_id, p) for r in rows for p in r.partners if r.doc_id < p}
    who = {x for p in true for x in p}
    counts = len(who), len({r.doc_id for r in rows}), len(true), len(pairs & true)
    assert counts[1] >= 0.95 * counts[0] and counts[3] >= 0.85 * counts[2], counts


def test_runs_of_links_are_told_by_their_ends(spark, monkeypatch):
    """Long texts that are edited here and there: a run of seeds that two share is two links, and gives what all its links give."""
    rng = random.Random(22)
    passage = prose(rng, 300)
    docs = []
    for i in range(40):
        words = list(passage)
        for at in rng.sample(range(300), 2):
            words[at] = f"edit{i}"
        docs.append((i, words))
    plain, counts = substring_dedup.written, {}

    def noted(df, tag):
        out = plain(df, tag)
        counts[tag] = out.count()
        return out

    monkeypatch.setattr(substring_dedup, "written", noted)
    got, few = spans(spark, docs), counts["pairs"]
    monkeypatch.setattr(substring_dedup, "along", lambda key, doc, place, way: (np.zeros(len(key), np.uint64),) * 2)
    assert spans(spark, docs) == got and got.keys() == set(range(40))
    assert 0 < few < counts["pairs"] / 2, (few, counts["pairs"])


def test_links_are_made_in_rounds(spark, monkeypatch):
    """No more links lie in files at once than a round may take, and all rounds together find what one does."""
    rng = random.Random(23)
    passage = prose(rng, 60)
    docs = [(i, prose(rng, 30) + [w if rng.random() > 0.06 else f"edit{i}" for w in passage] + prose(rng, 30)) for i in range(80)]
    docs += [(100 + i, prose(rng, 10) + ["so"] * rng.randrange(30, 70) + prose(rng, 10)) for i in range(30)]
    plain, made = substring_dedup.written, []

    def noted(df, tag):
        out = plain(df, tag)
        if tag == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "written", noted)
    got, all_ = spans(spark, docs), list(made)
    assert len(all_) == 1 and got.keys() >= set(range(80))
    made.clear()
    monkeypatch.setattr(substring_dedup, "LEAST_ROUND", all_[0] // 2)
    monkeypatch.setattr(substring_dedup, "LINK_BYTES", 1 << 40)
    monkeypatch.setattr(substring_dedup, "BLOCK", 16)
    monkeypatch.setattr(substring_dedup, "LOT", 64)
    assert spans(spark, docs) == got
    assert len(made) > 2 and sum(made) == all_[0] and max(made) < 0.8 * all_[0], (all_, made)


def test_one_chain_at_once():
    """Pairs whose runs make one chain are known without chaining them."""
    rng = random.Random(24)
    for _ in range(2000):
        runs, a, b = [], 0, 0
        for _ in range(rng.randrange(1, 6)):
            n = rng.randrange(5, 40)
            runs.append((a, b, n))
            a, b = a + n + rng.choice([0, 1, 3, 10, 30, 48, 50]), b + n + rng.choice([0, 1, 3, 10, 30, 48, 50]) - rng.choice([0, 0, 0, 0, n])
        runs.sort()
        p, q, n = (np.array(c) for c in zip(*runs))
        if substring_dedup._one_chain(np.array([0]), np.array([len(runs)]), p, q, n)[0]:
            assert substring_dedup.chains(runs) == [runs]
        elif len(runs) == 1:
            raise AssertionError(runs)


def test_whole_runs():
    begins, ends = substring_dedup.BEGINS, substring_dedup.ENDS
    links = [(1, 2, 0, 3, -5 - begins), (1, 2, 8, 11, -5), (1, 2, 40, 43, -5 - ends), (1, 2, 90, 93, -5 - begins), (1, 2, 93, 3, -5 - ends), (1, 2, 120, 123, -5 - ends), (1, 3, 0, 3, 7), (2, 3, 4, 7, -5 - ends)]
    got = substring_dedup.whole_runs(*(np.array(c, np.int64) for c in zip(*links)))
    # an end without its beginning stays a seed
    assert [*zip(*(c.tolist() for c in got))] == [(1, 2, 0, 3, -45), (1, 2, 8, 11, -5), (1, 2, 90, 93, -35), (1, 2, 93, 3, -5), (1, 3, 0, 3, 7), (2, 3, 4, 7, -5)]
    rng = np.random.default_rng(3)
    for _ in range(200):
        at = np.cumsum(rng.integers(1, 7, 60))
        key, doc = rng.integers(1, 1 << 60, 60).astype(np.uint64), np.repeat([0, 1], 30)
        (near, on), (before, back) = (substring_dedup.along(key, doc, at, way) for way in (1, -1))
        for i in range(60):
            j = i
            while j < 59 and doc[j + 1] == doc[i] and at[j + 1] - at[j] <= 5 and at[j] - at[i] < substring_dedup.NEAREST:
                j += 1
            assert (on[i] != 0) == (at[j] - at[i] >= substring_dedup.NEAREST) and (near[i] != 0) == (j > i)
            if j > i:
                assert before[i + 1] != 0
