"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at `distance` or fewer differing bits. The bits are
dealt into parts, correlated ones together; part i has a threshold t[i], with
sum(t) = distance - parts + 1, so a linked pair differs in at most t[i] bits of
some part i. Number and widths of the parts and their thresholds (-1: the part is
left out) are those of the least cost: for each of `SHAPES`, dynamic programming
allots thresholds by the candidate pairs that each part would give, estimated
from its histogram over all fingerprints, and by the keys it needs. The more
fingerprints there are, the fewer and wider the parts and the more unequal their
thresholds. A fingerprint is stored under its own value of part i and probes those
within t[i] bits of it; who is stored meets all, and candidates are verified in full.

* A bucket of more than `BUCKET` fingerprints is dealt by a further pigeonhole
  over its remaining bits, and so on: at each step a pair that is linked agrees
  in one of distance + 1 shares of what is left. As equal fingerprints are one
  node, a bucket with few bits left is small, so no bucket is compared whole.
* A bucket gives at most one link for each of its members, never all its pairs;
  components are found by star rounds.

A document without words has fingerprint zero and is linked like any other.
Null texts have no words. Repeated rows each give a row; null doc_ids give a
row but are never a component_id unless the component has no other. An empty
table gives no rows. A very long text has one fingerprint like any other. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mixed, partitions, salt, text_bytes, written
from .components import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
BITS = 64
#: Widths of parts that are weighed against each other, up to four of them.
SHAPES = [(16, 16, 16, 16), (13, 17, 17, 17), (19, 15, 15, 15), (22, 21, 21), (24, 20, 20), (26, 19, 19), (28, 18, 18), (32, 32), (36, 28), (40, 24)]
#: Bits of a part whose values are counted; what the others tell is reckoned.
COUNTED = 12
#: Fingerprints in a bucket that one task compares pair by pair.
BUCKET = 512
#: What a key costs, in candidate pairs.
KEY_COST = 8.0


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles (repeats count), as a signed long."""
    words = text.lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[lo : lo + (1 << 15)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_likeness(nodes: DataFrame) -> np.ndarray:
    """[bit, bit]: how much two bits go together, from counts over all nodes."""

    def count(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            b = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            both += b.T @ b
            n += len(b)
        i, j = np.indices(both.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel().astype(np.int64)) for x in (i, j, both, np.full_like(i, n))], ["i", "j", "both", "n"])

    rows = nodes.select("fp").mapInArrow(count, "i long, j long, both long, n long").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 1.0
    for r in rows:  # 4,096 counts
        both[r.i, r.j], n = r.both, max(r.n, 1)
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    likeness = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(likeness, 0)
    return likeness


def bit_groups(likeness: np.ndarray, widths: tuple[int, ...]) -> list[list[int]]:
    """Bits in parts of these widths, those that go together in the same part."""
    free, groups = set(range(BITS)), []
    for width in widths:
        group = [max(free, key=lambda b: (likeness[b, list(free)].sum(), -b))]
        free -= {*group}
        while len(group) < width:
            group.append(max(free, key=lambda b: (likeness[b, group].sum(), -b)))
            free -= {group[-1]}
        groups.append(sorted(group))
    return groups


def _values(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


def value_counts(nodes: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """For each group, how many nodes have which value of its first `COUNTED` bits."""
    heads = [g[:COUNTED] for g in groups]

    def count(batches):
        totals = [np.zeros(1 << len(g), np.int64) for g in heads]
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False))
            for total, g in zip(totals, heads, strict=True):
                total += np.bincount(_values(bits, g), minlength=len(total))
        for k, total in enumerate(totals):
            v = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(v), pa.array(total[v])], ["part", "value", "n"])

    rows = nodes.select("fp").mapInArrow(count, "part long, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    part, value, n = (rows.column(c).to_numpy() for c in ("part", "value", "n"))  # 4,096 counts for a group, whatever the input
    return [np.bincount(value[part == k], n[part == k], 1 << len(g)) for k, g in enumerate(heads)]


def candidate_counts(counts: list[np.ndarray], widths: tuple[int, ...], most: int = 2) -> np.ndarray:
    """[part, t]: about how many pairs differ in at most t bits of the part, for t = 0 to most."""
    out = np.zeros((len(widths), most + 1))
    for k, (n, w) in enumerate(zip(counts, widths, strict=True)):
        head = len(n).bit_length() - 1
        flips = [[0], [1 << i for i in range(head)], [1 << i | 1 << j for i in range(head) for j in range(i)]]
        at = np.arange(len(n))
        exact = [sum((n * n[at ^ m]).sum() for m in flips[t]) / 2 - (n.sum() / 2 if t == 0 else 0) for t in range(most + 1)]
        # of two prints, the bits that weren't counted differ like coins
        rest = [math.comb(w - head, j) / 2.0 ** (w - head) for j in range(most + 1)]
        for t in range(most + 1):
            out[k, t] = sum(exact[i] * sum(rest[: t - i + 1]) for i in range(t + 1))
    return out


def keys_of(width: int, t: int) -> int:
    """Values within t bits of a value."""
    return sum(math.comb(width, i) for i in range(t + 1))


def allocate(pairs: np.ndarray, widths, n: int, distance: int = DISTANCE, key_cost: float | None = None) -> tuple[float, list[int]]:
    """(cost, thresholds): at least -1 each, with sum distance - parts + 1 and the least cost, by dynamic programming."""
    key_cost = KEY_COST if key_cost is None else key_cost
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for k, w in enumerate(widths):
        found: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, pairs.shape[1]):
                new = cost + (pairs[k, t] + key_cost * n * keys_of(w, t) if t >= 0 else 0)
                if total + t not in found or new < found[total + t][0]:
                    found[total + t] = (new, [*chosen, t])
        best = found
    return best[distance - len(widths) + 1]


def plan(nodes: DataFrame, distance: int = DISTANCE, key_cost: float | None = None) -> tuple[list[list[int]], list[int]]:
    """(bits of each part, their thresholds) of the least cost among `SHAPES`."""
    likeness = bit_likeness(nodes)
    shapes = [s for s in SHAPES if len(s) <= distance + 1 and distance - len(s) + 1 <= 2 * len(s)] or [tuple([BITS // (distance + 1)] * distance + [BITS - distance * (BITS // (distance + 1))])]
    groups = [bit_groups(likeness, s) for s in shapes]
    counts = value_counts(nodes, [g for gs in groups for g in gs])
    n, best, at = int(counts[0].sum()), None, 0
    for shape, gs in zip(shapes, groups, strict=True):
        cost, thresholds = allocate(candidate_counts(counts[at : at + len(gs)], shape), shape, n, distance, key_cost)
        at += len(gs)
        if best is None or cost < best[0]:
            best = (cost, gs, thresholds)
    return best[1:]


def _key_rows(nodes: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, used, probe, fp): a row for each value that a fingerprint is met under; used holds the part's bits."""
    masks = [_mask(g) for g in groups]

    def scan(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            bits = _bits(fps)
            for g, t, mask in zip(groups, thresholds, masks, strict=True):
                if t < 0:
                    continue
                w = len(g)
                flips = [0, *(1 << i for i in range(w) if t >= 1), *(1 << i | 1 << j for i in range(w) for j in range(i) if t >= 2)]
                own = _values(bits, g)
                for lo in range(0, len(fps), 2000):
                    key = own[lo : lo + 2000, None] ^ np.array(flips)[None, :]
                    probe = np.tile(np.array(flips) != 0, len(key)).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.full(key.size, mask)), pa.array(probe), pa.array(np.repeat(fps[lo : lo + 2000], len(flips)))], ["key", "used", "probe", "fp"])

    return nodes.select("fp").mapInArrow(scan, "key long, used long, probe byte, fp long")


def _mask(bits: list[int]) -> np.int64:
    return np.uint64(sum(1 << b for b in bits)).astype(np.int64)


def _refined(rows: DataFrame, distance: int) -> DataFrame:
    """Rows of too large buckets, met again: of the bits that weren't used for a bucket, one in distance + 1 shares is equal."""

    def scan(batches):
        for batch in batches:
            key, used, probe, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "used", "probe", "fp"))
            bits = _bits(fps)
            for mask in np.unique(used):
                mine = np.flatnonzero(used == mask)
                rest = [b for b in range(BITS) if not int(mask) >> b & 1]
                for s in range(distance + 1):
                    share = rest[s :: distance + 1]
                    if share:
                        # the bucket so far and the share's value; a chance equality is one more candidate
                        new = mixed(key[mine].view(np.uint64) * np.uint64(distance + 1) + np.uint64(s)) + _values(bits[mine], share).view(np.uint64)
                        yield pa.RecordBatch.from_arrays([pa.array(mixed(new).view(np.int64)), pa.array(np.full(len(mine), np.int64(mask) | _mask(share))), pa.array(probe[mine]), pa.array(fps[mine])], ["key", "used", "probe", "fp"])

    return rows.select("key", "used", "probe", "fp").mapInArrow(scan, "key long, used long, probe byte, fp long")


def _links_in_buckets(rows: DataFrame, distance: int) -> DataFrame:
    """(u, v): links that join the linked members of each bucket, fewer than its members."""
    columns = ["key", "used"]

    def link(group_of: np.ndarray, probe: np.ndarray, fps: np.ndarray):
        n = len(fps)
        starts = np.r_[0, np.flatnonzero(np.diff(group_of)) + 1]
        sizes = np.diff(np.r_[starts, n])
        left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(starts, sizes))  # members from here on
        root, at, shift, held, us, vs = np.arange(n), np.flatnonzero(probe == 0), 1, 0, [], []  # those stored come first, and meet all behind them

        def merge():
            u, v = np.concatenate(us), np.concatenate(vs)
            while True:  # the least index spreads along the links
                a, b = root[u], root[v]
                if (a == b).all():
                    return
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while not (root[root] == root).all():
                    root[:] = root[root]

        while len(at := at[left[at] > shift]):
            near = at[np.bitwise_count((fps[at] ^ fps[at + shift]).view(np.uint64)) <= distance]
            near = near[fps[near] != fps[near + shift]]
            if len(near):
                us.append(near)
                vs.append(near + shift)
                held += len(near)
            if held > 1 << 20:
                merge()
                us, vs, held = [], [], 0
            shift += 1
        if us:
            merge()
        moved = np.flatnonzero(root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[root[moved]])], ["u", "v"])

    def scan(batches):
        kept = [np.empty(0, np.int64) for _ in range(4)]
        for batch in batches:
            now = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns, strict=True)]
            change = changes(now)
            cut = int(np.flatnonzero(change)[-1]) if change.any() else 0  # the last bucket may go on
            if cut:
                yield link(np.cumsum(change[:cut]), now[2][:cut], now[3][:cut])
            kept = [c[cut:] for c in now]
        if len(kept[0]):
            yield link(np.cumsum(changes(kept)), kept[2], kept[3])

    def changes(rows):
        out = np.zeros(len(rows[0]), bool)
        for c in rows[:2]:
            out[1:] |= c[1:] != c[:-1]
        return out

    dealt = rows.select(*columns, "probe", "fp").repartition(partitions(rows.sparkSession), *columns).sortWithinPartitions(*columns, "probe", "fp")
    return dealt.mapInArrow(scan, "u long, v long")


def _sized(rows: DataFrame) -> DataFrame:
    """rows with their bucket's size; buckets of one, or of none that is stored, are left out."""
    share = salt("fp").alias("share")
    stored = F.count_if(F.col("probe") == 0)
    counted = rows.groupBy("key", "used", share).agg(F.count("*").alias("n"), stored.alias("stored"))
    counted = counted.groupBy("key", "used").agg(F.sum("n").alias("size"), F.sum("stored").alias("stored"), F.collect_set("share").alias("shares"))
    sizes = counted.where("size > 1 AND stored > 0").select("key", "used", "size", F.explode("shares").alias("share"))
    return rows.select("*", share).join(sizes, ["key", "used", "share"]).select("key", "used", "probe", "fp", "size")


def near_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) links whose components are those of all pairs of nodes(fp) at `distance` or fewer bits."""
    rows, out = _key_rows(nodes, *plan(nodes, distance)), None
    while True:  # each round uses up a quarter of the bits that are left: some seven rounds at most
        rows = written(_sized(rows), "buckets")
        links = _links_in_buckets(rows.where(F.col("size") <= BUCKET), distance)
        out = links if out is None else out.unionAll(links)
        large = rows.where(F.col("size") > BUCKET)
        if large.isEmpty():
            return out
        rows = _refined(large, distance)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, fp (long), component_id (least doc_id linked with it at any distance)."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    # a third of all rows may have one fingerprint: a share of it for each salt
    share = salt("doc_id").alias("share")
    shares = prints.groupBy("fp", share).agg(F.lit(1).alias("one")).select("fp", "share")
    return prints.select("*", share).join(shares.join(of, "fp"), ["fp", "share"]).select("doc_id", "fp", "component_id")


def op5_simhash(spark, sf_dir) -> DataFrame:
    """Contract columns of near_duplicates() over whole documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
