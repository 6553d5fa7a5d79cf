import json
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pressmill.operators.health import job_state
from pressmill.streaming.freshness import state_of, watched


@pytest.mark.parametrize("minutes", [0, 2, 3, 5, 19, 20, 45])
@pytest.mark.parametrize("succeeded", [0, 1])
def test_states_equal_the_batch_ones(spark, minutes, succeeded):
    now = datetime(2024, 1, 1, 12)
    made = now - timedelta(minutes=minutes)
    kept = None if minutes >= 20 else made  # what is forgotten is no job
    row = spark.createDataFrame([(kept, None if kept is None else succeeded, now)], "created timestamp, succeeded int, now timestamp")
    batch = row.select(job_state(F.col("created"), F.col("succeeded"), F.col("now")).alias("s")).head().s
    assert state_of(made.timestamp(), succeeded, now.timestamp(), 20 * 60, 3 * 60) == batch


def test_silence_is_told(spark, tmp_path):
    """No row comes in any more, and yet the states go on: running to failed, ok to missing."""
    (tmp_path / "in").mkdir()
    stamp = lambda ago: (datetime.now(timezone.utc) - timedelta(seconds=ago)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")

    def land(name, *rows):
        draft = tmp_path / f"{name}.draft"
        draft.write_text("\n".join(json.dumps(dict(zip(("owner", "name", "created", "succeeded"), r, strict=True))) for r in rows))
        draft.rename(tmp_path / "in" / f"{name}.json")

    land("1", ("done", "j1", stamp(0), 1), ("stuck", "j2", stamp(0), 0), ("never", None, None, None), ("old", "j3", stamp(3600), 1))
    jobs = spark.readStream.schema("owner string, name string, created timestamp, succeeded int").json(str(tmp_path / "in"))
    query = watched(jobs, fresh=25, starting=12).writeStream.format("memory").queryName("freshness").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()

    def states():
        found: dict[str, list] = {}
        for r in spark.table("freshness").orderBy("at").collect():
            found.setdefault(r.owner, []).append(r.state)
        return found

    def until(want, seconds=90):
        end = time.time() + seconds
        while time.time() < end and query.isActive:
            if states() == want:
                return
            time.sleep(0.5)
        raise AssertionError((states(), query.exception()))

    try:
        until({"done": ["ok", "missing"], "stuck": ["running", "failed", "missing"], "never": ["missing"], "old": ["missing"]})
        land("2", ("done", "j4", stamp(0), 0))
        land("3", ("done", "j4", stamp(0), 1))
        end = time.time() + 60
        while time.time() < end and states()["done"][-1] != "ok":
            time.sleep(0.5)
        assert states()["done"][:2] == ["ok", "missing"] and states()["done"][-1] == "ok"
    finally:
        query.stop()
