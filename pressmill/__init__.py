"""News-feed analytics as Spark DataFrame jobs: ingest, de-duplicate, query, verify, monitor."""

from __future__ import annotations

import os


def ship(spark) -> None:
    """Lets Python workers of a local session import this package; a cluster gets it by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [root, *paths] if x)
