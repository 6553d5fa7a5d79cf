"""Health of the service from its jobs, pods and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import minutes_old

JOBS = "struct<items:array<struct<metadata:struct<name:string,creationTimestamp:string,ownerReferences:array<struct<name:string>>>,status:struct<succeeded:int>>>>"
PODS = "struct<items:array<struct<metadata:struct<name:string>,status:struct<containerStatuses:array<struct<name:string,state:struct<waiting:struct<reason:string>>>>>>>>"
CRASH = "CrashLoopBackOff"


def jobs(documents: DataFrame, body: str = "body") -> DataFrame:
    """(name, created, succeeded, owners) of each job in JSON listings."""
    parsed = documents.select(F.explode(F.from_json(body, JOBS)["items"]).alias("j"))
    owners = F.transform(F.coalesce("j.metadata.ownerReferences", F.array()), lambda o: o["name"])
    return parsed.select("j.metadata.name", F.try_to_timestamp("j.metadata.creationTimestamp").alias("created"), F.coalesce("j.status.succeeded", F.lit(0)).alias("succeeded"), owners.alias("owners"))


def containers(documents: DataFrame, body: str = "body") -> DataFrame:
    """(pod, container, reason) of each container in JSON listings; pods without any give none."""
    pods = documents.select(F.explode(F.from_json(body, PODS)["items"]).alias("p"))
    each = pods.select(F.col("p.metadata.name").alias("pod"), F.explode("p.status.containerStatuses").alias("c"))
    return each.select("pod", F.col("c.name").alias("container"), F.col("c.state.waiting.reason").alias("reason"))


def crashing_containers(rows: DataFrame) -> DataFrame:
    """One row: n, containers that crash again and again."""
    return rows.agg(F.count_if(F.col("reason") == CRASH).alias("n"))


def crashing_pods(rows: DataFrame) -> DataFrame:
    """One row: n, pods with such a container."""
    return rows.where(F.col("reason") == CRASH).agg(F.count_distinct("pod").alias("n"))


def latest_job(rows: DataFrame, owner: str) -> DataFrame:
    """One row: the owner's latest job, columns null where it has none. Runs started by hand have no owner."""
    own = rows.where(F.array_contains("owners", owner))
    return own.agg(F.max_by(F.struct("name", "created", "succeeded"), F.struct("created", "name")).alias("j")).select("j.*")


def jobs_named(rows: DataFrame, prefix: str) -> DataFrame:
    """Jobs by the beginning of their name, whoever owns them: those started by hand, too."""
    return rows.where(F.startswith(F.col("name").cast("string"), F.lit(prefix)))


def job_state(created: Column, succeeded: Column, now: Column) -> Column:
    """ok, running or failed; missing where there is no job."""
    age = minutes_old(created, now)
    return F.when(created.isNull() & succeeded.isNull(), "missing").when((succeeded == 1) & (age < 20), "ok").when(age < 3, "running").otherwise("failed")


def checked(skip: Column, good: Column) -> Column:
    return F.when(skip, "SKIPPED").when(good, "PASS").otherwise("FAIL")


def tally(checks: DataFrame, state: str = "state") -> DataFrame:
    """One row: passed, failed, skipped, healthy (nothing failed)."""
    s = F.col(state)
    return checks.agg(*[F.count_if(s == k).alias(n) for k, n in (("PASS", "passed"), ("FAIL", "failed"), ("SKIPPED", "skipped"))], (F.count_if(s == "FAIL") == 0).alias("healthy"))


def alerts(checks: DataFrame, state: str = "state", message: str = "message") -> DataFrame:
    """At most one row: how many checks failed, and what they say. Checks are a fixed few."""
    failed = checks.where(F.col(state) == "FAIL")
    return failed.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(message)), "; ").alias("messages")).where("n > 0")


#: Figures of the service and what they must be, by name.
RULES = {
    "countries": lambda v: v >= 5,
    "replicas": lambda v: v >= 1,
    "certificate_days": lambda v: v >= 14,
    "database_running": lambda v: v == 1,
    "crashing": lambda v: v == 0,
}


def service_checks(figures: DataFrame) -> DataFrame:
    """(name, state, message) of figures(name, value, skip): a figure that is missing fails."""
    good = F.lit(False)
    for name, rule in RULES.items():
        good = F.when(F.col("name") == name, rule(F.col("value"))).otherwise(good)
    state = checked(F.coalesce("skip", F.lit(False)), F.coalesce(good, F.lit(False)))
    said = F.concat_ws(" ", "name", F.lit("is"), F.coalesce(F.col("value").cast("string"), F.lit("unknown")))
    return figures.select("name", state.alias("state"), said.alias("message"))
