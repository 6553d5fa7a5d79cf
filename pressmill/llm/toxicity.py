"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words, lower-cased, and their beginnings of four to six
letters (for inflected forms and compounds), hashed to slots. The score is a
logistic of a bias, a weight for each slot that is present, and for each pair of
present slots the product of their factors, so a pair can weigh more, or less,
than its parts (an insult beside the mention of a group).

Slots in use are, first, those whose presence differs between toxic and other
training texts by `LEAST_Z` standard errors. Then those that only tell in a pair,
by the interaction of two presences and the label: with a slot of the first kind
(`BESIDE_Z`, a term of any frequency), or among the `PAIRED` slots that are most
often both there and not (`PAIR_Z`, neither need tell alone). A term that tells
in neither way has no weight to learn; without this choice rare terms drown the
others (held out at sf0.1, of toxic texts found: 0.90 with it, 0.50 with all slots).
The factors are fitted by AdaGrad on a bounded sample of `SAMPLE` labelled rows,
least hash of doc_id first. Labels are
learned from rows with crc32(doc_id) mod 4 other than 2; language, source and
doc_id never enter a score.

Null and empty texts have no terms and score as the bias says; every row gets a
score. Null labels are left out, of several labels of a doc_id the largest
counts. With no labels at all the score is 0.5 for every text. Repeated rows
stay; a very long text is scored whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

SLOTS = 1 << 22
PREFIXES = (4, 5, 6)
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
#: Slots in use, at most (the model is broadcast), and how much they must tell: alone, beside one that does, in a pair.
MOST_SLOTS, LEAST_Z, BESIDE_Z, PAIR_Z = 20_000, 3.0, 4.5, 6.5
#: Slots that are looked at in pairs.
PAIRED = 1024
#: Bytes of words and their slots that a task remembers.
REMEMBERED_BYTES = 96 << 20
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 15, 64, 0.1, 1e-5
THRESHOLD = 0.3
HELD_OUT = 2

_edges = re.compile(r"^\W+|\W+$")


def slot(term: str) -> int:
    return xxhash.xxh64_intdigest(term) % SLOTS


def word_slots(word: str) -> tuple[int, ...]:
    w = _edges.sub("", word)
    return (slot(w), *(slot(f"{w[:k]}~") for k in PREFIXES if len(w) > k)) if w else ()


def text_slots(text: str) -> np.ndarray:
    """The slots of all terms, each once."""
    found: set[int] = set()
    for w in {*text.lower().split()}:
        found.update(_known(w))
    return np.fromiter(found, np.int32, len(found))


_known = lru_cache(1 << 18)(word_slots)


def held_out(doc_id: Column) -> Column:
    """Whether the row's label is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


class Machine:
    """bias, weights and factors of the slots in use."""

    def __init__(self, slots: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.slots, self.bias, self.weights, self.factors = slots, bias, weights, factors
        self.place = {int(s): i for i, s in enumerate(slots)}
        self.words: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def __reduce__(self):
        return Machine, (self.slots, self.bias, self.weights, self.factors)

    def _of(self, word: str) -> tuple[int, ...]:
        got = tuple(self.place[s] for s in word_slots(word) if s in self.place)
        if self.held < REMEMBERED_BYTES:
            self.words[word] = got
            self.held += 160 + 2 * len(word) + 8 * len(got)
        return got

    def score(self, text: str) -> float:
        words = {*text.lower().split()}
        here: set[int] = set()
        for w, got in zip(words, map(self.words.get, words), strict=True):
            if got is None:
                got = self._of(w)
            if got:
                here.update(got)
        i = np.fromiter(sorted(here), np.int64, len(here))
        v = self.factors[i]
        z = self.bias + self.weights[i].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(slots: np.ndarray, rows: list[tuple[np.ndarray, int]]) -> Machine:
    """A machine for rows of (places of the slots present, label)."""
    rng = np.random.default_rng(0)
    n = len(slots)
    w, v = np.zeros(n), rng.normal(0, 0.02, (n, FACTORS))
    gw, gv, gb = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
    share = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    b = float(np.log(share / (1 - share)))
    labels = np.array([y for _, y in rows], float)
    for _ in range(EPOCHS if rows else 0):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            sizes = [len(rows[i][0]) for i in part]
            at = np.concatenate([rows[i][0] for i in part])
            of = np.repeat(np.arange(len(part)), sizes)
            va = v[at]
            total = np.zeros((len(part), FACTORS))
            np.add.at(total, of, va)
            z = b + np.bincount(of, w[at], len(part)) + 0.5 * ((total**2).sum(1) - np.bincount(of, (va**2).sum(1), len(part)))
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[part]) / len(part)
            own, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, error[of], len(own)) + DECAY * w[own]
            dv = np.zeros((len(own), FACTORS))
            np.add.at(dv, back, error[of][:, None] * (total[of] - va))
            dv += DECAY * v[own]
            gw[own] += dw * dw
            gv[own] += dv * dv
            gb += error.sum() ** 2
            w[own] -= RATE * dw / np.sqrt(gw[own])
            v[own] -= RATE * dv / np.sqrt(gv[own])
            b -= RATE * error.sum() / np.sqrt(gb)
    return Machine(slots, b, w, v)


def _interaction(cells):
    """Standard errors by which two presences and the label depend on each other; cells[label, a, b] are counts."""
    sign = np.array([[[1, -1], [-1, 1]], [[-1, 1], [1, -1]]])
    x = np.moveaxis(np.asarray(cells, float), (0, 1, 2), (-3, -2, -1)) + 0.5
    return (np.log(x) * -sign).sum((-3, -2, -1)) / np.sqrt((1 / x).sum((-3, -2, -1)))


def _beside(rows: DataFrame, marks: set[int]) -> set[int]:
    """Slots that tell otherwise beside a slot of `marks` than without one: at most `MOST_SLOTS`, those that tell the most."""
    beside = rows.sparkSession.sparkContext.broadcast(marks)

    def flag(batches):
        for batch in batches:
            slots = batch.column(0).to_pylist()
            held = [[s for s in x if s in beside.value] for x in slots]
            # a slot isn't beside itself
            flags = [[len(h) > (s in beside.value) for s in x] for x, h in zip(slots, held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.list_(pa.bool_())), batch.column(1)], ["slots", "flags", "toxic"])

    flagged = rows.mapInArrow(flag, "slots array<int>, flags array<boolean>, toxic int")
    b, y = F.col("x.flags").cast("int"), F.col("toxic")
    each = flagged.select(F.explode(F.arrays_zip("slots", "flags")).alias("x"), "toxic")
    cells = [F.sum(c).alias(k) for k, c in (("n", F.lit(1)), ("y", y), ("b", b), ("by", b * y))]
    counts = each.groupBy(F.col("x.slots").alias("slot")).agg(*cells).where("n >= 8 AND y > 0 AND y < n AND b > 0 AND b < n")
    every = flagged.select(F.exists("flags", lambda f: f).cast("int").alias("b"), "toxic").agg(F.count("*").alias("n"), F.sum("toxic").alias("y"), F.sum("b").alias("b"), F.sum(F.col("b") * F.col("toxic")).alias("by")).head()
    if not every.n:
        return set()
    with_it = {(1, 1): F.col("by"), (1, 0): F.col("b") - F.col("by"), (0, 1): F.col("y") - F.col("by"), (0, 0): F.col("n") - F.col("b") - F.col("y") + F.col("by")}
    total = {(1, 1): every.by, (1, 0): every.b - every.by, (0, 1): every.y - every.by, (0, 0): every.n - every.b - every.y + every.by}
    logs, spread = F.lit(0.0), F.lit(0.0)
    for (flag_, label), here in with_it.items():
        for there, count in ((1, here), (0, F.greatest(F.lit(total[flag_, label]) - here, F.lit(0)))):
            sign = (1 if flag_ else -1) * (1 if label else -1) * (1 if there else -1)
            logs, spread = logs + sign * F.log(count + 0.5), spread + 1 / (count + 0.5)
    z = F.abs(logs) / F.sqrt(spread)
    return {r.slot for r in counts.select("slot", z.alias("z")).where(F.col("z") >= BESIDE_Z).orderBy(F.desc("z"), "slot").limit(MOST_SLOTS).collect()}


def _paired(rows: DataFrame, often: list[int]) -> set[int]:
    """Those of `often` that tell in a pair with another of them."""
    place = {s: i for i, s in enumerate(often)}
    f = len(often)

    def count(batches):
        both = np.zeros((2, f, f))
        sizes = np.zeros(2)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                labels = np.array(part.column(1).to_pylist())
                there = np.zeros((part.num_rows, f), np.float32)
                for i, slots in enumerate(part.column(0).to_pylist()):
                    there[i, [place[s] for s in slots if s in place]] = 1
                for y in (0, 1):
                    x = there[labels == y]
                    both[y] += x.T @ x
                    sizes[y] += len(x)
        one = np.einsum("yii->yi", both)
        a, b = one[:, :, None], one[:, None, :]
        cells = np.stack([np.stack([sizes[:, None, None] - a - b + both, b - both], 1), np.stack([a - both, both], 1)], 1)
        z = np.abs(_interaction(np.maximum(cells, 0)))
        z[np.arange(f), np.arange(f)] = 0
        # all four combinations must be there
        z[(cells.sum(0).min((0, 1)) < 8)] = 0
        found = np.flatnonzero(z.max(1, initial=0) >= PAIR_Z)
        yield pa.RecordBatch.from_arrays([pa.array([often[i] for i in found], pa.int64())], ["slot"])

    # the sample is bounded, and `PAIRED` slots of it are looked at
    return {r.slot for r in rows.repartition(1).mapInArrow(count, "slot long").collect()} if f > 1 else set()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learns labels.toxic on at most `sample` rows of docs."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def prepare(batches):
        for batch in batches:
            slots = [np.sort(text_slots(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.list_(pa.int32())), batch.column(1)], ["slots", "toxic"])

    # the broadcast side has `sample` rows of a few bytes at most
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    rows = written(rows.mapInArrow(prepare, "slots array<int>, toxic int"), "terms")
    total, toxic = (float(x or 0) for x in rows.agg(F.count("*"), F.sum("toxic")).head())
    other = total - toxic

    def odds(n, of):
        return F.log((n + 0.5) / (F.lit(of) - n + 0.5))

    n, p = F.col("n"), F.col("p")
    z = (odds(p, toxic) - odds(n - p, other)) / F.sqrt(1 / (p + 0.5) + 1 / (n - p + 0.5))
    each = rows.select(F.explode("slots").alias("slot"), "toxic")
    counts = each.groupBy("slot").agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).where("n >= 3").withColumn("z", z)
    tell = counts.where(F.abs("z") >= LEAST_Z)
    alone = {r.slot for r in tell.orderBy(F.desc(F.abs("z")), "slot").limit(MOST_SLOTS).collect()}
    marks = {r.slot for r in tell.where("z > 0").orderBy(F.desc("z"), "slot").limit(MOST_SLOTS).collect()}
    often = [r.slot for r in counts.orderBy(F.desc(F.least("n", F.lit(total) - F.col("n"))), "slot").limit(PAIRED).collect()]
    used = np.sort(np.array([*(alone | _beside(rows, marks) | _paired(rows, often))], np.int64))

    def place(batches):
        for batch in batches:
            found = []
            for slots in batch.column(0).to_pylist():
                at = np.searchsorted(used, slots)
                found.append(at[(at < len(used)) & (used[np.minimum(at, len(used) - 1)] == slots)] if len(used) else [])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["places", "toxic"])

    def learn(batches):
        got = [(np.array(at, np.int64), label) for batch in batches for at, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        got.sort(key=lambda r: (r[1], len(r[0]), r[0].tolist()))
        m = fit(used, got)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (m.bias, m.weights, m.factors.ravel())], ["bias", "weights", "factors"])

    # the sample is bounded, and only its places in the model's slots go to the one task that fits it
    placed = rows.mapInArrow(place, "places array<int>, toxic int")
    one = placed.repartition(1).mapInArrow(learn, "bias double, weights array<double>, factors array<double>").collect()
    if not one:
        return Machine(used, 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    return Machine(used, one[0].bias, np.array(one[0].weights), np.array(one[0].factors).reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            scores = [model.value.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, score double")


def op6_toxicity(spark, sf_dir) -> DataFrame:
    """Contract columns of score() over whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
