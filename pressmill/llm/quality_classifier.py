"""A quality classifier learned from overlapping heuristic labellers, without labels.

Each labeller looks at one side of a text and votes junk, good or nothing. The
votes of all documents are counted by pattern (3 ** labellers patterns at most),
and expectation-maximisation on these counts estimates how often each labeller
votes what on junk and on good text, and with that the probability that a
document of a pattern is good. These posteriors are the soft labels from which
a linear scorer on hashed features is trained; the scorer sees the whole text
and decides, also where labellers disagree or say nothing.

The scorer is fitted on about `SAMPLE` documents, chosen by a hash of
doc_id and text; the votes are counted over all documents. Only the chosen
documents' features go to the task that fits it: 4,101 slots of a document at
most, whatever the length of its text.

Null and empty texts get no vote and score as the scorer's bias says. Rows are
never merged or dropped by ``score``; extra columns stay, and one named like the
new column is replaced. A very long text is one document like any other. An
empty table gives an empty table.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JUNK, GOOD, NOTHING = 0, 1, 2
DIM = 1 << 14
#: Documents that the scorer is fitted on, about, and at most twice that.
SAMPLE = 20_000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.5, 1e-6
THRESHOLD = 0.5

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it was for on with as be at by this from or an are "
    "le la les des du de et un une que qui dans pour par sur est pas "
    "der die das und ein eine nicht mit sich auf den von zu ist im "
    "el los las del y en una por con para su se al es como".split()
)

#: Classes of bytes: lower, upper, digit, space, line end, full stop, comma, other sentence ends, quotes and
#: brackets, dash, exclamation, bar, hash or star, dollar or percent, other ASCII, beyond ASCII.
_CLASS = np.full(256, 14, np.uint8)
for _i, _c in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b";:?", b"'\"()[]", b"-_", b"!", b"|", b"#*", b"$%&", b"", bytes(range(128, 256)))
):
    _CLASS[list(_c)] = _i


def measures(text: str) -> dict[str, float]:
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    count = text.count
    ascii_text = text.encode("ascii", "ignore")
    upper = len(ascii_text) - len(ascii_text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return {
        "words": len(words),
        "symbols": sum(map(count, "#*$%&<>")) / n,
        "bars": count("|") / n,
        "upper": upper / max(len(text) - count(" "), 1),
        "cries": count("!") / n,
        "ends": sum(map(count, (". ", ".\n", "? ", "?\n"))) / n + text.rstrip().endswith((".", "?")) / n,
        "distinct": len(set(words)) / n,
        "stutter": sum(map(eq, words, words[1:])) / n,
        "same_lines": 1 - len(set(lines)) / max(len(lines), 1),
        "length": (len(text) - len(words)) / n,
        "function": sum(map(FUNCTION_WORDS.__contains__, words)) / n,
    }


def _range(low_junk, low, high, high_junk):
    """A labeller that calls values in [low, high] good and those beyond the outer limits junk."""
    return lambda x: GOOD if low <= x <= high else JUNK if x < low_junk or x > high_junk else NOTHING


_symbols = _range(-1, -1, 0.01, 0.1)
_bars = _range(-1, -1, 0.01, 0.1)
_upper = _range(-1, 0.001, 0.15, 0.35)
_cries = _range(-1, -1, 0.02, 0.1)
_ends = _range(0.005, 0.03, 0.25, 1)
_lines = _range(-1, -1, 0.1, 0.45)
_stutter = _range(-1, -1, 0.04, 0.15)
_length = _range(2.0, 3.8, 6.2, 7.5)
_function = _range(0.01, 0.06, 0.6, 0.9)


def _variety(m: dict) -> int:
    """Distinct words against what running text of the length has."""
    if m["words"] < 40:
        return NOTHING
    usual = min(0.9, 1.6 * m["words"] ** -0.15)
    return JUNK if m["distinct"] < 0.6 * usual else GOOD if m["distinct"] > 0.8 * usual else NOTHING


#: The labellers, by name; each votes on a document's measures.
LABELLERS = {
    "symbols": lambda m: _symbols(m["symbols"]),
    "bars": lambda m: _bars(m["bars"]),
    "upper": lambda m: _upper(m["upper"]),
    "cries": lambda m: _cries(m["cries"]),
    "ends": lambda m: _ends(m["ends"]) if m["words"] >= 5 else NOTHING,
    "stutter": lambda m: _stutter(m["stutter"]) if m["words"] >= 20 else NOTHING,
    "same_lines": lambda m: _lines(m["same_lines"]) if m["words"] >= 20 else NOTHING,
    "length": lambda m: _length(m["length"]) if m["words"] >= 20 else NOTHING,
    "function": lambda m: _function(m["function"]) if m["words"] >= 20 else NOTHING,
    "variety": _variety,
}


def pattern(m: dict) -> int:
    """All votes as one number of base 3."""
    out = 0
    for vote in LABELLERS.values():
        out = out * 3 + vote(m)
    return out if m["words"] else 3 ** len(LABELLERS) - 1


def _hashed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int64)


def features(text: str, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): hashed trigrams of character classes, and hashed steps of the measures."""
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.zeros(4096, np.int64)
    for lo in range(0, len(raw), 1 << 20):
        c = _CLASS[raw[lo : lo + (1 << 20) + 2]].astype(np.int32)
        counts += np.bincount((c[:-2] << 8) + (c[1:-1] << 4) + c[2:], minlength=4096)
    kinds = np.flatnonzero(counts)
    values = np.sqrt(counts[kinds] / max(counts.sum(), 1))
    steps = [int(20 * m["distinct"] / min(0.9, 1.6 * max(m["words"], 40) ** -0.15)), int(10 * m["same_lines"]), int(10 * m["stutter"]), int(min(15, m["length"])), int(20 * m["function"])]
    named = np.array([4096 + 64 * i + min(s, 63) for i, s in enumerate(steps)])
    return _hashed(np.concatenate([kinds, named])), np.concatenate([values, np.full(len(named), 0.6)])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability of good for each pattern, by expectation-maximisation over independent labellers."""
    k = len(LABELLERS)
    votes = patterns[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3
    says = np.stack([votes == v for v in (JUNK, GOOD, NOTHING)], axis=2).astype(float)
    # start: good means that no labeller objects
    good = 0.9 * 0.3 ** says[:, :, JUNK].sum(1)
    for _ in range(rounds):
        by_class = np.stack([counts * (1 - good), counts * good])
        share = (by_class.sum(1) + 1) / (counts.sum() + 2)
        # a vote's rate in each class, smoothed; saying nothing tells nothing
        rate = np.einsum("cp,pkv->ckv", by_class, says)[:, :, :2] + 1
        rate /= rate.sum(2, keepdims=True)
        logs = np.log(share)[:, None] + np.einsum("ckv,pkv->cp", np.log(rate), says[:, :, :2])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        done = np.abs(new - good).max() < 1e-6
        good = new
        if done:
            break
    return good


def vote_counts(docs: DataFrame) -> DataFrame:
    """(pattern, n) over all documents."""

    def scan(batches):
        for batch in batches:
            seen = np.array([pattern(measures(t or "")) for t in batch.column(0).to_pylist()], np.int64)
            kinds, n = np.unique(seen, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["pattern", "n"])

    return docs.select("text").mapInArrow(scan, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        slots, values = features(text, measures(text))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(self.weights[slots] @ values) + self.bias))))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> Scorer:
    """Logistic regression on soft labels by AdaGrad; the order of rows is theirs."""
    w, g = np.zeros(DIM + 1), np.full(DIM + 1, 1e-2)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS if rows else 0):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // BATCH)):
            slots = np.concatenate([np.append(rows[i][0], DIM) for i in part])
            values = np.concatenate([np.append(rows[i][1], 1.0) for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) + 1 for i in part])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[slots] * values, len(part)), -50, 50)))
            error = p - np.array([rows[i][2] for i in part])
            grad = np.bincount(slots, error[of] * values, DIM + 1) / len(part) + DECAY * w
            g += grad * grad
            w -= RATE * grad / np.sqrt(g)
    return Scorer(w[:DIM], float(w[DIM]))


def train(docs: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Votes of all documents, posteriors of their patterns, and a scorer fitted on about `sample` documents."""
    spark = docs.sparkSession
    counted = vote_counts(docs).collect()  # no more rows than patterns
    patterns = np.array([r.pattern for r in counted], np.int64)
    counts = np.array([r.n for r in counted], float)
    posterior = dict(zip(patterns.tolist(), estimate(patterns, counts).tolist(), strict=True)) if counted else {}
    good = spark.sparkContext.broadcast(posterior)
    share = min(1.0, sample / max(counts.sum(), 1))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("text")

    def prepare(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                m = measures(t or "")
                slots, values = features(t or "", m)
                out.append({"slots": slots, "values": values, "good": good.value.get(pattern(m), 0.5)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("slots", pa.list_(pa.int16())), ("values", pa.list_(pa.float32())), ("good", pa.float64())]))

    def fit(batches):
        rows = [(np.array(r["slots"], np.int64), np.array(r["values"]), r["good"]) for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tolist(), r[1].tolist()))
        scorer = fit_linear(rows)
        yield pa.RecordBatch.from_arrays([pa.array([scorer.weights]), pa.array([scorer.bias])], ["weights", "bias"])

    # features first, then the limit: the rows of the one task that fits are bounded, and so is each of them
    rows = chosen.mapInArrow(prepare, "slots array<short>, values array<float>, good double").limit(2 * sample)
    one = rows.repartition(1).mapInArrow(fit, "weights array<double>, bias double").collect()
    return Scorer(np.array(one[0].weights), one[0].bias) if one else fit_linear([])


def score(docs: DataFrame, scorer: Scorer, name: str = "quality") -> DataFrame:
    """docs with quality (probability of good, double), under a name of choice."""
    kept = [f for f in docs.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def scan(batches):
        for batch in batches:
            scores = [model.value.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(scores, pa.float64())], schema.names)

    return docs.mapInArrow(scan, schema)


def op8_quality_classifier(spark, sf_dir) -> DataFrame:
    """doc_id, quality and kept (quality at least 0.5) of whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs)).select("doc_id", "quality", (F.col("quality") >= THRESHOLD).alias("kept"))
