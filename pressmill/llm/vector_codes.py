"""Vector code compression: product codes with integer arithmetic, found by partial-distance search.

Components become integers, floor(1024 * x), so every distance, tie and mean is
exact and the same on any machine. A vector is cut into PARTS parts; each has a
codebook of ENTRIES entries. A round assigns all vectors in the tasks that read
them and sends only sums and counts of the entries on: at most PARTS * ENTRIES *
width rows a task, combined before the shuffle, and 256 times a vector's length
on the driver, however many vectors there are.

``nearest`` walks the dimensions in descending variance of the codebook. The first
few give each vector a likely entry, whose complete distance is the bound; an entry
is masked out as soon as its accumulated distance strictly exceeds that, so ties
stay and go to the lowest index.

Rows whose vector is null, or holds null or non-finite components, are dropped; so
are vectors of another length than the first kept one's. A length that PARTS doesn't
divide is cut as evenly as whole components allow, an empty vector costs nothing. Of
fewer than ENTRIES vectors each is an entry. Null vec_ids come behind all others,
equal ones in the order of their vectors; all repeated rows are kept and coded alike.
Columns other than vec_id, embedding and label are ignored. An empty table gives no
rows. Components so large that a squared distance passes a long are refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SALTS, salt, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Dimensions that are searched between two looks at the bound, and vectors searched together.
STEP, BLOCK = 4, 1024


def cuts(width: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [width * p // PARTS for p in range(PARTS + 1)]


def integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x), exact: a double holds 1024 times any float, and a scaling by a power of two rounds nothing."""
    whole = np.floor(values.astype(np.float64) * SCALE)
    if whole.size and 4 * whole.shape[-1] * float(np.abs(whole).max()) ** 2 >= 2.0**62:
        raise OverflowError("components whose squared distances pass a long")
    return whole.astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors of one width, as integers."""
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width))


def search_order(book: np.ndarray) -> np.ndarray:
    """Dimensions by descending variance of the entries, in whole numbers: n * sum of squares - square of the sum."""
    n, sums = len(book), book.sum(0).astype(object)
    spread = [n * int(s) - int(t) ** 2 for s, t in zip((book.astype(object) ** 2).sum(0), sums, strict=True)] if n else [0] * book.shape[1]
    return np.array(sorted(range(book.shape[1]), key=lambda d: -spread[d]), np.int64)


def _narrow(rows: np.ndarray, book: np.ndarray) -> type:
    most = max((int(np.abs(a).max()) for a in (rows, book) if a.size), default=0)
    return np.int32 if 4 * most * most * max(rows.shape[1], 1) < 2**31 else np.int64


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance, ties to the lower index; by partial distances."""
    order = search_order(book)
    kind = _narrow(rows, book)
    # dimension first: what is searched together lies together
    x, c = np.ascontiguousarray(rows.T[order], kind), np.ascontiguousarray(book.T[order], kind)
    best_entry, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for lo in range(0, len(rows), BLOCK):
        best_entry[lo : lo + BLOCK], best[lo : lo + BLOCK] = _searched(x[:, lo : lo + BLOCK], c, kind)
    return best_entry, best


def _searched(x: np.ndarray, c: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    dims, n = x.shape
    so_far = np.zeros((n, c.shape[1]), kind)
    for d in range(min(STEP, dims)):
        so_far += np.square(x[d][:, None] - c[d][None, :])
    likely = so_far.argmin(1)
    bound = so_far[np.arange(n), likely]
    for d in range(STEP, dims):
        bound = bound + np.square(x[d] - c[d][likely])
    row, entry = np.nonzero(so_far <= bound[:, None])  # entries of a row ascend
    part = so_far[row, entry]
    for d0 in range(STEP, dims, STEP):
        for d in range(d0, min(d0 + STEP, dims)):
            part += np.square(x[d][row] - c[d][entry])
        stay = part <= bound[row]  # only what is strictly farther goes
        row, entry, part = row[stay], entry[stay], part[stay]
    first = np.searchsorted(row, np.arange(n))  # the likely entry itself always stays
    least = np.minimum.reduceat(part, first) if n else part
    hit = np.flatnonzero(part == least[row])
    return entry[hit[np.searchsorted(row[hit], np.arange(n))]], least


def codable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, label of the rows that have a whole finite vector."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & ~bad)


def first_books(kept: DataFrame) -> list[np.ndarray] | None:
    """The parts of the ENTRIES least vec_ids' vectors; None if there are none. A top-k: so many rows reach the driver."""
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    least = kept.orderBy(*order).select("embedding").head()
    if least is None:
        return None
    width = len(least.embedding)
    head = kept.where(F.size("embedding") == width).orderBy(*order).limit(ENTRIES).select("embedding").collect()
    rows = integers(np.array([r.embedding for r in head], np.float64).reshape(len(head), width))
    at = cuts(width)
    return [rows[:, a:b] for a, b in zip(at, at[1:], strict=False)]


def improved(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one more round; entries that nothing was assigned to stay."""
    width = sum(b.shape[1] for b in books)
    at = cuts(width)

    def scan(batches):
        sums = [np.zeros_like(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            rows = matrix(batch.column(0), width)
            for p, book in enumerate(books):
                part = rows[:, at[p] : at[p + 1]]
                entry, _ = nearest(part, book)
                counts[p] += np.bincount(entry, minlength=len(book))
                by = np.argsort(entry, kind="stable")
                used = np.flatnonzero(np.diff(entry[by], prepend=-1))
                if len(used):
                    sums[p][entry[by][used]] += np.add.reduceat(part[by], used)
        for p in range(PARTS):
            entry, place = np.nonzero(np.ones_like(sums[p]))
            some = counts[p][entry] > 0
            columns = [np.full(some.sum(), p), entry[some], place[some], sums[p][entry[some], place[some]], counts[p][entry[some]]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "place", "total", "n"])

    moved = kept.select("embedding").mapInArrow(scan, "part long, entry long, place long, total long, n long")
    new = [b.copy() for b in books]
    for r in moved.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        new[r.part][r.entry, r.place] = r.total // r.n
    return new


def train(kept: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray] | None:
    books = first_books(kept)
    if books is None:
        return None
    same = kept.where(F.size("embedding") == sum(b.shape[1] for b in books))
    for _ in range(rounds):
        books = improved(same, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error, the squared distance to what the code decodes to."""
    width = sum(b.shape[1] for b in books)
    at = cuts(width)

    def scan(batches):
        for batch in batches:
            rows = matrix(batch.column(1), width)
            codes, error = np.zeros((len(rows), PARTS), np.uint8), np.zeros(len(rows), np.int64)
            for p, book in enumerate(books):
                entry, distance = nearest(rows[:, at[p] : at[p + 1]], book)
                codes[:, p] = entry
                error += distance
            text = codes.tobytes().hex()
            code = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    rows = kept.where(F.size("embedding") == width).select("vec_id", "embedding", "label")
    return rows.mapInArrow(scan, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray], column: str = "code", to: str = "embedding") -> DataFrame:
    """codes with the vectors they stand for, as doubles."""
    tables = [b / SCALE for b in books]

    def look_up(parts):
        for code in parts:
            raw = np.frombuffer(bytes.fromhex("".join(code)), np.uint8).reshape(-1, PARTS)
            yield code.to_frame().assign(v=list(np.hstack([t[raw[:, p]] for p, t in enumerate(tables)])))["v"]

    return codes.withColumn(to, F.pandas_udf(look_up, "array<double>", F.PandasUDFType.SCALAR_ITER)(column))


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors of equal labels together. A label that many rows share is dealt to many tasks."""
    share = salt("vec_id", "code").alias("share")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    every = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_share"))
    dealt = coded.withColumn("share", share)
    return dealt.join(every, dealt["label"].eqNullSafe(every["_label"]) & (dealt["share"] == every["_share"])).drop("_label", "_share", "share")


def op13_vector_codes(spark, sf_dir) -> DataFrame:
    """Contract columns: codes of whole embeddings, trained on all of them."""
    kept = codable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books = train(kept)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256")).where("false")
    coded = written(encode(kept, books), "codes")  # searched once, read twice
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as chained tables; every distance is computed in full."""
    assign = "SELECT r, part, min({'d': d, 'entry': entry}) AS x FROM (SELECT r, part, entry, sum((v - c) * (v - c)) AS d FROM comp JOIN b%d USING (part, place) GROUP BY r, part, entry) GROUP BY r, part"
    rounds = "".join(
        f""", a{i} AS MATERIALIZED ({assign % i})
, b{i + 1} AS MATERIALIZED (
  SELECT part, entry, place, coalesce((s - ((s % n) + n) % n) // n, c) AS c
  FROM b{i} LEFT JOIN (SELECT part, x.entry AS entry, place, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM comp JOIN a{i} USING (r, part) GROUP BY ALL) USING (part, entry, place)
)"""
        for i in range(ROUNDS)
    )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comp AS MATERIALIZED (
  SELECT r, i // (len(e) // {PARTS}) AS part, i % (len(e) // {PARTS}) AS place, CAST(floor({SCALE} * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT r, e, unnest(range(len(e))) AS i FROM kept)
), b0 AS MATERIALIZED (SELECT part, r AS entry, place, v AS c FROM comp WHERE r < {ENTRIES})
{rounds}
, a AS ({assign % ROUNDS})
, done AS (SELECT r, string_agg(printf('%02x', x.entry), '' ORDER BY part) AS code, CAST(sum(x.d) AS BIGINT) AS error FROM a GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{ROUNDS}) AS codebooks_sha256
FROM kept JOIN done USING (r)
"""


OP13_SQL = _sql()
