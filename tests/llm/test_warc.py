import base64
import gzip
import hashlib
import io
import random

import pyarrow as pa
import pytest

from pressmill.llm import warc
from pressmill.llm._shared import new_path
from pressmill.llm.queries import oracle_sql, queries

from ..oracle import same


def test_equals_sql(spark, tables):
    same(queries()["op3_warc"](spark, tables), tables, oracle_sql()["op3_warc"])


ODD = [(3, "http://b.org/?b=2&a=1", "same"), (1, "https://WWW.b.org", "same"), (2, None, "same"), (4, "no url\r\nX: y", ""), (5, "http://é.org/ü", None), (6, "http://[", "ß\r\n\r\n"), (None, "http://c.org", "alone"), (6, "http://[", "ß\r\n\r\n")]


def history(spark, rows, **more):
    return warc.histories(spark.createDataFrame(rows, "page_id bigint, url string, html string"), new_path(spark, "warc"), **more)


def test_odd_pages(spark):
    got = {r.page_id: r for r in history(spark, ODD).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        "3": ("response", None), "1": ("revisit", "3"), "2": ("revisit", "3"), "4": ("revisit", "5"), "5": ("response", None), "6": ("response", None), None: ("response", None),
    }
    for page, _, html in ODD:
        raw = (html or "").encode()
        r = got[None if page is None else str(page)]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert got["3"].urlkey == "org,b)/?a=1&b=2" and got["1"].urlkey == "org,b)/"
    assert history(spark, ODD).count() == len(ODD)
    assert history(spark, []).count() == 0


def test_small_payloads_are_no_revisits(spark):
    got = history(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], least=3).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]


def test_archives_are_gzip_members():
    payload = b"<p>\r\n\r\n</p>"
    raw = [warc.record(i, "http://a.org", payload, warc.digest(payload), len(payload)) for i in range(3)]
    raw.append(warc.record(9, "http://a.org", None, warc.digest(payload), len(payload), 2))
    data = b"".join(gzip.compress(r) for r in raw)
    assert gzip.decompress(data) == b"".join(raw)
    got = list(warc.members(io.BytesIO(data)))
    assert [m for _, _, m in got] == raw and all(gzip.decompress(data[o : o + n]) == m for o, n, m in got)
    assert warc.capture(raw[3])["refers_to"] == "2" and warc.capture(raw[0])["payload_bytes"] == len(payload)
    with pytest.raises(ValueError, match="digest"):
        warc.capture(raw[0].replace(b"<p>", b"<q>"))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(50), k=rng.randint(0, 30))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_order_with_several_passes(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet").repartition(9)
    path = new_path(spark, "warc")
    found = warc.captures(warc.write_archives(pages, path), path).repartition(9)
    out = warc.merge(found, fan_in=2).collect()  # partitions come in order
    keys = [tuple(r[c] for c in warc.ORDER) for r in out]
    assert keys == sorted(keys) and len(keys) == pages.count()
    fs, root = pa.fs.FileSystem.from_uri(path)
    r = out[7]
    with fs.open_input_file(f"{root}/{r.file}") as f:  # the index leads to the record
        f.seek(r.offset)
        assert warc.capture(gzip.decompress(f.read(r.length)))["page_id"] == r.page_id


def test_a_payload_that_most_pages_share(spark):
    rows = [(i, f"http://a.org/{i}", "x" * 100_000 if i == 77 else "hot" if i % 3 else f"own {i}") for i in range(600)]
    got = {int(r.page_id): r for r in history(spark, rows).collect()}
    last = max(i for i, _, html in rows if html == "hot")
    assert len(got) == 600 and got[77].payload_bytes == 100_000
    assert all((r.record_type, r.refers_to) == (("response", None) if i == last or rows[i][2] != "hot" else ("revisit", str(last))) for i, r in got.items())
