"""WARC archives of pages, and their index by external merge.

Writing: pages with equal payloads are found by digest; of these the one with
the largest page_id is stored as a response record, the others as revisit
records that name it and carry no payload. Of equal payloads within a batch only
those of the largest page_id are sent on, and the pages of a digest are dealt to
many tasks, so a payload that a third of all pages share is no burden. Every task writes archives of its
own (a gzip member for each record) and the manifest names those of tasks that
succeeded.

Indexing: each archive is read from start to end, payloads are held against
their digests, and its captures are written as a run sorted by URL key (host
reversed, as in SURT), time and place. Runs are merged by a loser tree, `FAN_IN`
at a time while there are more, and the last merge works on ranges of the keys
side by side. The result is the history of all captures in order: rows of a
partition are sorted, and come before those of the next.

``pages`` has no capture times: the n-th second from `FIRST_CAPTURE` stands for
page_id n. A null html is an empty payload. A null or odd url is kept as far as
a header can hold it. Rows that repeat both payload and the largest page_id are
responses all; null page_ids are the smallest. An empty table gives no archives
and no captures. Columns other than page_id, url and html are ignored, whatever
they are called. A large payload is one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import UTC, datetime, timedelta
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import new_path, partitions, salt, written

FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Compressed bytes after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
#: Runs that are merged at once.
FAN_IN = 64
#: Keys that are looked at for each range that the last merge is cut into.
KEYS_A_RANGE = 100

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "urlkey string, time long, page_id string, record_type string, payload_digest string, payload_bytes long, refers_to string, file string, offset long, length long"
_names = [c.split()[0] for c in CAPTURE.split(", ")]
_schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in CAPTURE.split(", ")])


def url_key(url: str) -> str:
    """The URL with its host reversed, without scheme, default port, www and fragment, and with sorted parameters."""
    try:
        parts = urlsplit(url.strip().lower())
        port = parts.port
    except ValueError:
        return url.strip().lower()
    if not parts.hostname:
        return url.strip().lower()
    host = ",".join(reversed(re.sub(r"^www\d*\.", "", parts.hostname).split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        host += f":{port}"
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{host}){parts.path or '/'}" + (f"?{query}" if query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else quote(str(page_id))}>"


def record(page_id, url: str | None, payload: bytes | None, sha1: str, size: int, refers_to=None) -> bytes:
    """A WARC record; payload None: a revisit of refers_to."""
    seconds = int(page_id) if re.fullmatch(r"\d{1,10}", str(page_id)) else 0
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = {
        "WARC-Type": "response" if payload is not None else "revisit",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": (FIRST_CAPTURE + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": quote(url or "", safe="%:/?#[]@!$&'()*+,;=~-._"),
        "WARC-Payload-Digest": f"sha1:{sha1}",
    }
    if payload is None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to)}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), "", ""]).encode() + block + b"\r\n\r\n"


def members(stream):
    """(offset, length, bytes) of each gzip member of a stream."""
    offset, at, data, inflate, out = 0, 0, b"", zlib.decompressobj(31), []
    while True:
        if not data and not (data := stream.read(1 << 20)):
            return
        got = inflate.decompress(data)
        out.append(got)
        if inflate.eof:
            at += len(data) - len(inflate.unused_data)
            yield offset, at - offset, b"".join(out)
            data, offset, inflate, out = inflate.unused_data, at, zlib.decompressobj(31), []
        else:
            at += len(data)
            data = b""


def capture(raw: bytes) -> dict:
    """What the index keeps of a record; a payload that doesn't match its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    page = lambda urn: unquote(urn[len("<urn:page:") : -1]) or None
    return {
        "urlkey": url_key(unquote(fields["WARC-Target-URI"])),
        "time": int(datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp()),
        "page_id": page(fields["WARC-Record-ID"]),
        "record_type": kind,
        "payload_digest": sha1,
        "payload_bytes": size,
        "refers_to": page(fields["WARC-Refers-To"]) if kind == "revisit" else None,
    }


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives under path; (file, records) of each."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"))
    # a share of a digest's pages for each salt, at most; only ids and digests are counted
    share = salt("page_id", "url").alias("share")
    counted = rows.where(F.col("size") >= least).groupBy("sha1", share).agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    shared = counted.groupBy("sha1").agg(F.max("response").alias("response"), F.sum("n").alias("n"), F.collect_set("share").alias("shares")).where("n > 1")
    shared = shared.select("sha1", "response", F.explode("shares").alias("share"), F.lit(True).alias("shared"))

    def lightened(batches):
        for batch in batches:
            ids, digests, sizes = (batch.column(c).to_pylist() for c in ("page_id", "sha1", "size"))
            largest: dict[str, object] = {}
            for i, h in zip(ids, digests, strict=True):
                if h not in largest or i is not None and (largest[h] is None or i > largest[h]):
                    largest[h] = i
            keep = pa.array([n < least or i == largest[h] for i, h, n in zip(ids, digests, sizes, strict=True)])
            yield batch.set_column(2, "payload", pc.if_else(keep, batch.column("payload"), pa.scalar(None, batch.column("payload").type)))

    found = rows.mapInArrow(lightened, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])).select("*", share).join(shared, ["sha1", "share"], "left")
    revisit = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    found = found.select(F.col("page_id").cast("string"), "url", F.when(~revisit, F.col("payload")).alias("payload"), "sha1", "size", F.col("response").cast("string").alias("response"))
    fs, root = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)

    def write(batches):
        fs, root = pa.fs.FileSystem.from_uri(path)
        out, size, n, name = None, 0, 0, ""
        files, counts = [], []
        parts = (batch.slice(lo, 500) for batch in batches for lo in range(0, batch.num_rows, 500))
        for part in parts:
            for page_id, url, html, sha1, length, response in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"  # each attempt has files of its own
                    out, size, n = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                sha1 = base64.b32encode(bytes.fromhex(sha1)).decode()
                deflate = zlib.compressobj(1, wbits=31)
                raw = deflate.compress(record(page_id, url, None if html is None else html.encode(), sha1, length, response)) + deflate.flush()
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    files, counts, out = [*files, name], [*counts, n], None
        if out:
            out.close()
            files, counts = [*files, name], [*counts, n]
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(counts, pa.int64())], ["file", "records"])

    return written(found.mapInArrow(write, "file string, records long"), "archives")


def captures(archives: DataFrame, path: str) -> DataFrame:
    """A row for each record of the archives, read from them."""

    def read(batches):
        fs, root = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for offset, length, raw in members(stream):
                        rows.append(capture(raw) | {"file": file, "offset": offset, "length": length})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, _schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, _schema)

    return archives.select("file").repartition(partitions(archives.sparkSession), "file").mapInArrow(read, CAPTURE)


ORDER = ["urlkey", "time", "file", "offset"]


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of their matches, so the next winner takes one match a level."""

    def __init__(self, sources, key):
        self.sources, self.key = [iter(s) for s in sources], key
        self.k = max(1, len(self.sources))
        self.rows = [next(s, None) for s in self.sources] or [None]
        self.keys = [None if r is None else key(r) for r in self.rows]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.losers[node] < 0:  # the other side hasn't played yet
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.rows[top := self.losers[0]] is not None:
            yield self.rows[top]
            self.rows[top] = row = next(self.sources[top], None)
            self.keys[top] = None if row is None else self.key(row)
            self._play(top)


def _key(row: tuple) -> tuple:
    return row[0], row[1], row[7], row[8]


def _run(file: str, low: tuple | None, high: tuple | None):
    """The rows of a sorted run from low (inclusive) to high (exclusive)."""
    fs, path = pa.fs.FileSystem.from_uri(file)
    with fs.open_input_file(path) as stream:
        run = pq.ParquetFile(stream)
        groups = []
        for g in range(run.num_row_groups):
            stats = run.metadata.row_group(g).column(0).statistics
            if stats is None or not stats.has_min_max or (low is None or stats.max >= low[0]) and (high is None or stats.min <= high[0]):
                groups.append(g)
        for batch in run.iter_batches(1024, row_groups=groups, columns=_names) if groups else ():
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if low is not None and _key(row) < low:
                    continue
                if high is not None and _key(row) >= high:
                    return
                yield row


def _merged(rows):
    part = []
    for row in rows:
        part.append(row)
        if len(part) == 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _schema, strict=True)], schema=_schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _schema, strict=True)], schema=_schema)


def merge(found: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """All captures in order of URL key and time: sorted runs, merged by loser trees."""
    spark = found.sparkSession
    table = written(found.sortWithinPartitions(*ORDER), "runs")  # each file is a sorted run
    files = sorted(table.inputFiles())
    while len(files) > fan_in:
        groups = [files[i : i + fan_in] for i in range(0, len(files), fan_in)]

        def merge_group(batches, groups=groups):
            for batch in batches:
                for g in batch.column(0).to_pylist():
                    yield from _merged(LoserTree([_run(f, None, None) for f in groups[g]], _key))

        table = written(spark.range(0, len(groups), 1, len(groups)).mapInArrow(merge_group, CAPTURE), "runs")
        files = sorted(table.inputFiles())
    ranges = partitions(spark)
    share = min(1.0, KEYS_A_RANGE * ranges / max(1, table.count()))
    picked = F.pmod(F.xxhash64("file", "offset"), F.lit(1 << 30)) < int(share * (1 << 30))
    keys = sorted(tuple(r) for r in table.where(picked).select(*ORDER).limit(4 * KEYS_A_RANGE * ranges).collect())
    cuts = [None, *(keys[i * len(keys) // ranges] for i in range(1, ranges) if keys), None]

    def merge_range(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                low, high = cuts[i : i + 2]
                yield from _merged(LoserTree([_run(f, low, high) for f in files], _key))

    return spark.range(0, len(cuts) - 1, 1, len(cuts) - 1).mapInArrow(merge_range, CAPTURE)


def histories(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> DataFrame:
    """Archives of the pages under path, read back into the merged index of all captures."""
    return merge(captures(write_archives(pages, path, least), path))


def op3_warc(spark, sf_dir) -> DataFrame:
    """Contract columns of the captures of whole pages, from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType
    found = histories(pages, new_path(spark, "warc"))
    return found.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM p)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM g
"""
