"""Whether jobs still run, as a stream: a state is told when it changes, also where no event comes in.

The states are those of health.job_state: ok, running, failed, and missing where an owner
has no job of the last `fresh` seconds. A job is forgotten then, and a timer tells it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "owner string, name string, state string, at timestamp"


def state_of(created: float | None, succeeded: int | None, now: float, fresh: float, starting: float) -> str:
    if created is None or now - created >= fresh:
        return "missing"
    if succeeded == 1:
        return "ok"
    return "running" if now - created < starting else "failed"


class Freshness(StatefulProcessor):
    """Rows (owner, name, created, succeeded): jobs as they are seen, again and again. A row without a job makes its owner one that is expected to have some."""

    def __init__(self, fresh: float = 20 * 60, starting: float = 3 * 60):
        self.fresh, self.starting = fresh, starting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "name string, created double, succeeded int")
        self.told = handle.getValueState("told", "state string")

    def _tell(self, key, now: float) -> Iterator[pd.DataFrame]:
        name, created, succeeded = self.job.get() if self.job.exists() else (None, None, None)
        state = state_of(created, succeeded, now, self.fresh, self.starting)
        if state == "missing" and self.job.exists():
            self.job.clear()
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if state != "missing":  # when it may change by itself
            ends = self.starting if state == "running" else self.fresh
            self.handle.registerTimer(int((created + ends) * 1000) + 1)
        if not self.told.exists() or self.told.get()[0] != state:
            self.told.update((state,))
            yield pd.DataFrame({"owner": [key[0]], "name": [name if state != "missing" else None], "state": [state], "at": [pd.Timestamp(round(now * 1000), unit="ms")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = pd.concat(list(rows)).dropna(subset=["created"])
        if len(seen):
            # of the latest job what was seen last: a success is not taken back
            best = max(zip(seen["created"].map(pd.Timestamp.timestamp), seen["name"], seen["succeeded"].fillna(0).astype(int), strict=True))
            now = self.job.get() if self.job.exists() else None
            if now is None or (best[0], best[1]) > (now[1], now[0]) or (best[0], best[1]) == (now[1], now[0]) and best[2] > now[2]:
                self.job.update((best[1], best[0], best[2]))
        yield from self._tell(key, timerValues.getCurrentProcessingTimeInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._tell(key, timerValues.getCurrentProcessingTimeInMs() / 1000)

    def close(self) -> None:
        pass


def watched(jobs: DataFrame, fresh: float = 20 * 60, starting: float = 3 * 60) -> DataFrame:
    """A stream of jobs(owner, name, created, succeeded) as changes of state; needs the RocksDB state store."""
    return jobs.groupBy("owner").transformWithStateInPandas(Freshness(fresh, starting), OUTPUT, "append", "processingTime")
