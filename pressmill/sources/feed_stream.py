"""Feeds as a streaming source: spark.readStream.format("feeds").

The offset is the number of the poll. Answers are landed in a folder of the state before
they are handed on, each task's in a file of its own, so a batch that runs again, after a
failure or a restart, reads what was landed and asks nobody twice. When a batch is
committed, the validators of its answers (ETag, Last-Modified) are folded into one file,
its landed answers go, and the next poll asks with them; an answer that says "not modified"
is a row with status 304 and no body.

State, per poll n: n.begun (when), n.landed/ (answers), and of the last committed poll
n.validators. A poll is due `every` seconds after the one before began.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

#: Rows of a landed file that are held at once.
HELD = 16


@dataclass
class _Part(InputPartition):
    poll: int
    landed: str | None  # a file of answers, or none: feeds to ask
    feeds: list
    slots: int


class FeedStream(DataSourceStreamReader):
    """options: feeds (JSON list of url), state (a folder that all machines see), every (seconds), slots, tasks."""

    def __init__(self, options):
        self.feeds = [{"url": f["url"]} for f in json.loads(options["feeds"])]
        self.slots, self.tasks = int(options.get("slots", "20")), int(options.get("tasks", "2"))
        self.every, self.state = float(options.get("every", "300")), options["state"]

    def _store(self):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.state if "://" in self.state else f"file://{self.state}")
        files.create_dir(root, recursive=True)
        return files, root

    def _names(self) -> list[tuple[int, str]]:
        """(poll, what) of all that the state holds."""
        from pyarrow import fs

        files, root = self._store()
        names = [x.base_name for x in files.get_file_info(fs.FileSelector(root))]
        return sorted((int(n.split(".")[0]), n.split(".")[1]) for n in names if n.split(".")[0].isdigit() and n.count(".") == 1)

    def _write(self, name: str, text: str) -> None:
        files, root = self._store()
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as f:
            f.write(text.encode())
        files.move(draft, f"{root}/{name}")

    def _read(self, name: str) -> str:
        files, root = self._store()
        with files.open_input_stream(f"{root}/{name}") as f:
            return f.read().decode()

    def _landed(self, poll: int) -> list[str]:
        from pyarrow import fs

        files, root = self._store()
        found = files.get_file_info(fs.FileSelector(f"{root}/{poll:012d}.landed", allow_not_found=True))
        return sorted(x.path for x in found if x.base_name.endswith(".parquet"))

    def _answers(self, path: str, columns: list[str] | None = None) -> Iterator[dict]:
        import pyarrow.parquet as pq

        files, _ = self._store()
        with files.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(HELD, columns=columns):
                yield from batch.to_pylist()

    def _validators(self, upto: int) -> dict[str, list]:
        """[etag, last_modified] by url after a poll: of its last answer that came whole."""
        names = self._names()
        last = max((n for n, what in names if what == "validators" and n <= upto), default=0)
        known = json.loads(self._read(f"{last:012d}.validators")) if last else {}
        for poll in sorted(n for n, what in names if what == "landed" and last < n <= upto):
            for path in self._landed(poll):
                for a in self._answers(path, ["url", "status", "etag", "last_modified"]):
                    if a["status"] is not None and a["status"] < 300:
                        known[a["url"]] = [a["etag"], a["last_modified"]]
        return known

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max((n for n, what in self._names() if what == "begun"), default=0)
        if not last or time.time() - float(self._read(f"{last:012d}.begun")) >= self.every:
            last += 1
            self._write(f"{last:012d}.begun", str(time.time()))
        return {"poll": last}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        from .feeds import shares

        out: list[_Part] = []
        for poll in range(start["poll"] + 1, end["poll"] + 1):
            done: set[str] = set()
            for path in self._landed(poll):
                out.append(_Part(poll, path, [], 0))
                done.update(a["url"] for a in self._answers(path, ["url"]))
            if poll == end["poll"]:  # polls that were begun and left are not made up for
                known = self._validators(poll - 1)
                asked = [f | dict(zip(("etag", "last_modified"), known.get(f["url"], (None, None)), strict=True)) for f in self.feeds if f["url"] not in done]
                tasks = max(1, min(self.tasks, self.slots, len(asked)))
                out += [_Part(poll, None, asked[i::tasks], share) for i, share in enumerate(shares(self.slots, tasks)) if asked]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        path = partition.landed or self._land(partition)
        for a in self._answers(path):
            yield a["url"], a["status"], a["body"], a["etag"], a["last_modified"], a["error"]

    def _land(self, partition: _Part) -> str:
        import pyarrow as pa
        import pyarrow.parquet as pq

        from .feeds import answers

        schema = pa.schema([("url", pa.string()), ("status", pa.int32()), ("body", pa.string()), ("etag", pa.string()), ("last_modified", pa.string()), ("error", pa.string())])
        files, root = self._store()
        folder = f"{root}/{partition.poll:012d}.landed"
        files.create_dir(folder, recursive=True)
        draft, path = f"{folder}/{uuid.uuid4().hex}.draft", f"{folder}/{uuid.uuid4().hex}.parquet"
        with files.open_output_stream(draft) as out, pq.ParquetWriter(out, schema) as writer:
            held: list[tuple] = []
            for a in answers(partition.feeds, partition.slots):
                if a:
                    held.append(a)
                if len(held) >= HELD:
                    writer.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema))
                    held = []
            if held:
                writer.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema))
        files.move(draft, path)
        return path

    def commit(self, end: dict) -> None:
        files, root = self._store()
        poll = end["poll"]
        if poll and (poll, "validators") not in self._names():
            self._write(f"{poll:012d}.validators", json.dumps(self._validators(poll)))
        for n, what in self._names():
            if what == "landed" and n <= poll:
                files.delete_dir(f"{root}/{n:012d}.landed")
            elif what in ("validators", "begun") and n < poll:
                files.delete_file(f"{root}/{n:012d}.{what}")
