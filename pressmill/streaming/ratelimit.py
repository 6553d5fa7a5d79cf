"""Rate limits: so many requests in a window that opens with a client's first one.

``limited`` keeps a window for each client in a stream; ``log_limited`` finds the same
windows in a log of any size, where one client may have a third of all requests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import carried, placed, reached
from ..scratch import written

OUTPUT = "client string, at timestamp, status int"


class Limiter(StatefulProcessor):
    """Rows (client, at) get status 200, or 429 from the request behind the limit until the window ends."""

    def __init__(self, limit: int = 100, seconds: float = 60):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "opened double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        opened, n = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for at in batch["at"]:
            now = at.timestamp()
            if opened is None or now - opened >= self.seconds:
                opened, n = now, 0
            n += 1
            out.append(200 if n <= self.limit else 429)
        self.state.update((opened, n))
        yield pd.DataFrame({"client": key[0], "at": batch["at"].to_numpy(), "status": out})

    def close(self) -> None:
        pass


def limited(requests: DataFrame, limit: int = 100, seconds: float = 60) -> DataFrame:
    """A stream of requests(client, at) with their status; needs the RocksDB state store."""
    return requests.groupBy("client").transformWithStateInPandas(Limiter(limit, seconds), OUTPUT, "append", "None")


def log_limited(requests: DataFrame, order: list[str]) -> DataFrame:
    """requests(client, at, most, seconds, ...) with opened, the start of their window, nth in it, and status 200 or 429.

    most and seconds are the client's limit (one for each client); order tells requests of one instant apart. The first
    request that is a window later than another is found for all at once, in the order of their times. Those that open
    windows are then what is reached from each client's first by such jumps, and a request belongs to the last of them
    before it. A client's log is cut into blocks wherever it is long.
    """
    rows = written(placed(requests, ["client", "at", *order], "place"), "requests")
    late = F.col("at") + F.make_dt_interval(secs=F.col("seconds"))
    # requests, and the instants from which on each one's window is over: in front of a request of that instant
    marks = rows.select("client", "at", F.lit(1).alias("kind"), "place").unionAll(rows.select("client", late.alias("at"), F.lit(0).alias("kind"), "place"))
    ordered = placed(marks, ["client", "at", "kind", "place"], "mark").withColumn("mark", -F.col("mark"))
    request = F.when(F.col("kind") == 1, F.struct("client", "place"))
    over = carried(ordered, "mark", request, "next").where("kind = 0 AND next.client <=> client")
    first = rows.groupBy("client").agg(F.min("place").alias("place"))
    opening = reached(first, over.select("place", F.col("next.place").alias("to"))).withColumn("opens", F.lit(True))
    whole = rows.join(opening, "place", "left")
    told = carried(whole, "place", F.when(F.col("opens"), F.struct("place", "at")), "window")
    nth = F.col("place") - F.col("window.place") + 1
    out = told.withColumns({"opened": F.col("window.at"), "nth": nth, "status": F.when(nth <= F.col("most"), 200).otherwise(429)})
    return out.drop("place", "opens", "window")
