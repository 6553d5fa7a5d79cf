"""A pool of request slots inside a task: whichever slot is free takes the next request.

``completed`` runs a function over rows in a bounded number of threads that share one
queue, and yields results as they come. A slow request holds up its own slot only; one
that passes its deadline is given up and reported, and its slot joins in again when the
request lets it go, so no more than `slots` requests are ever open. Queues are bounded:
rows are taken from the input as slots get free, and slots wait while nobody takes
their results, so a task holds a few results, however many rows it is dealt.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

#: Seconds after which a lull is reported, for results to be handed on.
LULL = 0.5


class Overdue(Exception):
    """A request that passed its deadline, or was never made because the whole poll's had passed."""


class _Request:
    def __init__(self, row):
        self.row, self.began, self.given_up = row, None, False


def completed(rows: Iterator, work: Callable, slots: int, seconds: float, until: float | None = None) -> Iterator[tuple | None]:
    """(row, result, error) of each row in order of completion; None in a lull.

    seconds: a request's deadline. until: a time.monotonic() from which on no request is made any more.
    """
    todo: queue.Queue = queue.Queue()
    done: queue.Queue = queue.Queue(2 * slots)
    lock = threading.Lock()

    def slot() -> None:
        while (request := todo.get()) is not None:
            with lock:
                if request.given_up:
                    continue
                request.began = time.monotonic()
            try:
                result = (request.row, work(request.row), None)
            except Exception as e:
                result = (request.row, None, e)
            with lock:
                if request.given_up:
                    continue
            done.put((request, result))

    threads = [threading.Thread(target=slot, daemon=True) for _ in range(slots)]
    for t in threads:
        t.start()
    waiting: dict[int, _Request] = {}
    rows, more = iter(rows), True
    try:
        while True:
            while more and len(waiting) < 2 * slots:
                row = next(rows, rows)
                if row is rows:
                    more = False
                    break
                request = _Request(row)
                waiting[id(request)] = request
                todo.put(request)
            if not waiting:
                return
            try:
                request, result = done.get(timeout=LULL)
            except queue.Empty:
                result = None
            if result is not None:
                if waiting.pop(id(request), None):
                    yield result
            else:
                yield None
            now = time.monotonic()
            closed = until is not None and now >= until
            for key, request in list(waiting.items()):
                with lock:
                    late = closed if request.began is None else closed or now - request.began > seconds
                    # a result that is on its way counts
                    request.given_up = late and not any(r is request for r, _ in list(done.queue))
                if request.given_up:
                    del waiting[key]
                    yield request.row, None, Overdue("the poll's deadline passed" if closed else f"no answer within {seconds:g} seconds")
    finally:
        for _ in threads:
            todo.put(None)
