import itertools
import select
import socket
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from pressmill.plans import cycle
from pressmill.sources import feeds
from pressmill.sources.pool import Overdue, completed


class Site(ThreadingHTTPServer):
    """Answers after ?s= seconds, as ?kind= says; knows how many requests were open at once."""

    daemon_threads, request_queue_size = True, 128

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Answer)
        self.open = self.most = 0
        self.lock, self.asked = threading.Lock(), []

    @property
    def root(self):
        return f"http://127.0.0.1:{self.server_port}"


class Answer(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        with self.server.lock:
            self.server.open += 1
            self.counted = True
            self.server.most = max(self.server.most, self.server.open)
            self.server.asked.append((self.path, self.headers.get("If-None-Match")))
        try:
            end = time.monotonic() + float(q.get("s", 0))
            while time.monotonic() < end:
                time.sleep(0.02)
                if select.select([self.connection], [], [], 0)[0] and not self.connection.recv(1, socket.MSG_PEEK):
                    return  # the asker is gone
            if q.get("kind") == "error":
                self.closed()
                self.send_error(500)
                return
            tag = f'"{urlsplit(self.path).path}"'
            if self.headers.get("If-None-Match") == tag:
                self.closed()
                self.send_response(304)
                self.end_headers()
                return
            body = b"<rss><channel><item><title>T%s</title><link>https://e.org</link></item></channel></rss>" % urlsplit(self.path).path.encode()
            self.send_response(200)
            self.send_header("ETag", tag)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            step = 8 if q.get("kind") == "drops" else len(body)
            for i in range(0, len(body), step):
                if i + step >= len(body):
                    self.closed()  # before the asker can know that it has all
                self.wfile.write(body[i : i + step])
                self.wfile.flush()
                time.sleep(0.3 * (step == 8))
        except OSError:
            pass
        finally:
            self.closed()

    def closed(self):
        with self.server.lock:
            self.server.open -= self.counted
            self.counted = False


@pytest.fixture
def site():
    server = Site()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def plan(spark, urls):
    rows = [(i, 1, 1, "rss", u, None, None) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "id int, publisher_id int, country_id int, feed_type string, feed_url string, etag string, last_modified string")


def test_a_slow_request_delays_nobody():
    """Lists dealt beforehand would make every fourth request wait behind the slow one."""
    began, order = time.monotonic(), []
    waits = {0: 1.5} | {i: 0.05 for i in range(1, 61)}
    for done in completed(iter(range(61)), lambda i: time.sleep(waits[i]) or i, 4, 10):
        if done:
            order.append(done[1])
    assert sorted(order) == list(range(61)) and order[-1] == 0  # in order of completion
    assert time.monotonic() - began < 1.5 + 60 * 0.05 / 3 + 0.7


def test_deadlines_errors_and_bounds():
    taken = itertools.count()
    release = threading.Event()

    def rows():
        for i in range(200):
            next(taken)
            yield i

    def work(i):
        if i == 3:
            release.wait(20)
        if i == 5:
            raise ValueError("five")
        return i

    got = completed(rows(), work, 3, 0.6)
    first = next(x for x in got if x)
    assert next(taken) <= 2 * 3 + 2  # no more than a few rows are taken ahead
    found = [first, *(x for x in got if x)]
    release.set()
    assert sorted(x[0] for x in found) == list(range(200))
    assert {x[0]: type(x[2]) for x in found if x[2]} == {3: Overdue, 5: ValueError}
    closed = [x for x in completed(iter(range(9)), lambda i: time.sleep(0.8), 2, 9, time.monotonic() + 0.3) if x]
    assert sorted(x[0] for x in closed) == list(range(9)) and all(isinstance(x[2], Overdue) for x in closed)
    assert list(completed(iter([]), work, 3, 1)) == []


def test_never_more_open_than_slots(spark, site):
    urls = [f"{site.root}/hang?s=30"] + [f"{site.root}/{i}?s=0.15" for i in range(80)] + [f"{site.root}/e?kind=error", "http://127.0.0.1:1/none", f"{site.root}/drops?kind=drops"]
    cycle.fetched(plan(spark, urls[1:5])).collect()  # starts workers
    began = time.monotonic()
    rows = {r.id: r for r in cycle.fetched(plan(spark, urls), slots=8, tasks=2, seconds=2).collect()}
    took = time.monotonic() - began
    assert len(rows) == len(urls) and site.most <= 8
    assert rows[0].error and "2 seconds" in rows[0].error or "timed out" in rows[0].error
    assert rows[81].error == "HTTP 500" and rows[82].error and rows[83].error and rows[0].body is None
    assert all(rows[i].status == 200 and f"T/{i - 1}<" in rows[i].body for i in range(1, 81))
    assert took < 3 + 80 * 0.15 / 6 + 3  # the longest, the sum by slots, and starting tasks


def test_a_poll_ends_at_its_deadline(spark, site):
    rows = cycle.fetched(plan(spark, [f"{site.root}/{i}?s=1" for i in range(40)]), slots=4, tasks=2, deadline=2.2).collect()
    done = [r for r in rows if r.status == 200]
    assert len(rows) == 40 and 4 <= len(done) <= 16 and all("deadline" in r.error for r in rows if r.status is None)


def test_data_source_uses_the_pool(spark, site):
    import json

    spark.dataSource.register(feeds.FeedSource)
    asked = [{"url": f"{site.root}/{i}?s=0.05", "etag": f'"/{i}"' if i % 2 else None} for i in range(30)]
    df = spark.read.format("feeds").option("feeds", json.dumps(asked)).option("slots", "5").option("tasks", "2").load()
    rows = df.groupBy("status").agg(F.count("*").alias("n"), F.count("body").alias("bodies")).collect()
    assert {(r.status, r.n, r.bodies) for r in rows} == {(200, 15, 15), (304, 15, 0)} and site.most <= 5
    assert feeds.shares(20, 3) == [7, 7, 6]
