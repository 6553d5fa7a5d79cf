import pytest
from pyspark.sql import functions as F

from pressmill import schemas
from pressmill.operators import health, moderation, quality, upsert
from pressmill.plans import read_api
from pressmill.sources import tables as store


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def news(spark):
    countries = frame(spark, [(1, "CI", "Côte d'Ivoire"), (2, "NG", "Nigeria")], "id int, iso_code string, name string")
    for name, kind in [(f.name, f.dataType) for f in schemas.countries() if f.name not in countries.columns]:
        countries = countries.withColumn(name, F.lit(None).cast(kind))
    publishers = frame(spark, [(1, 1, "Test Publisher CI", "https://example.com/ci"), (2, 2, "Test Publisher NG", "https://example.com/ng")], "id int, country_id int, name string, homepage_url string")
    publishers = publishers.withColumns({"logo_url": F.lit(None).cast("string"), "feed_status": F.lit("active"), "language": F.lit("fr")})
    articles = frame(
        spark,
        [(1, 1, 1, "CI Article One", "politics", 3), (2, 1, 1, "CI Article Two", "sports", 2), (3, 2, 2, "NG Article One", "other", 3), (4, 1, 1, "CI undated", "other", None)],
        "id int, publisher_id int, country_id int, headline string, category string, h int",
    ).withColumn("published_at", F.timestamp_seconds(F.col("h") * 3600))
    return countries, publishers, articles


def test_read_queries(spark, news):
    countries, publishers, articles = news
    assert [r.iso_code for r in read_api.list_countries(countries).collect()] == ["CI", "NG"]
    assert read_api.country(countries, "ci").head().name == "Côte d'Ivoire"
    with pytest.raises(read_api.NotFound):
        read_api.found(read_api.country(countries, "zz"))
    assert read_api.publishers(publishers, countries, "ci").count() == 1
    ask = lambda **k: [r.id for r in read_api.articles(articles, publishers, countries, **k).collect()]
    assert ask(iso="ci") == [1, 2, 4]
    assert ask(iso="ci", limit="1") == [1]
    assert ask(iso="ci", limit=2, offset=1) == [2, 4]
    assert ask(iso="ci", category="sports") == [2]
    assert ask(iso="ci", category="") == [1, 2, 4]
    assert ask(iso="zz") == []
    with pytest.raises(Exception, match="(?i)limit"):
        ask(iso="ci", limit="-5")
    assert read_api.article(articles, publishers, 1).head().publisher_name == "Test Publisher CI"
    assert read_api.article(articles, publishers, 999999999).isEmpty()


def test_page_plan_is_top_k(spark, news):
    plan = read_api.articles(news[2], news[1], news[0], "ci")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_insert_ignore(spark):
    old = frame(spark, [("a", 1)], "k string, v int")
    new = frame(spark, [("a", 9), ("b", 3), ("b", 2), ("c", None)], "k string, v int")
    got = upsert.insert_ignore(old, new, ["k"], ["v"]).collect()
    assert sorted(map(tuple, got), key=str) == [("b", 2), ("c", None)]


def test_upserts(spark):
    old = frame(spark, [(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = frame(spark, [(2, None, "z"), (3, "c", "q")], "k int, v string, w string")
    rows = lambda update: sorted(map(tuple, upsert.upsert(old, new, ["k"], update).collect()))
    assert rows(["v", "w"]) == [(1, "a", "x"), (2, None, "z"), (3, "c", "q")]
    assert rows(["w"]) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "q")]
    assert rows([]) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "q")]


def test_poll_status(spark):
    feeds = frame(spark, [(i, None, None, "old", "m") for i in range(1, 5)], "id int, last_fetched_at timestamp, last_status string, etag string, last_modified string")
    polls = frame(spark, [(1, "ok", None, None), (2, "not_modified", "x", "x"), (3, "error: HTTP 500", None, None)], "id int, status string, etag string, last_modified string")
    got = {r.id: (r.last_status, r.etag, r.last_modified, r.last_fetched_at is not None) for r in upsert.merge_poll_status(feeds, polls, F.current_timestamp()).collect()}
    assert got == {1: ("ok", None, None, True), 2: ("not_modified", "old", "m", True), 3: ("error: HTTP 500", "old", "m", True), 4: (None, "old", "m", False)}


def test_ids_of_empty_tables(spark):
    none = frame(spark, [], "id bigint")
    got = upsert.with_ids(frame(spark, [("b",), ("a",)], "n string"), none, ["n"]).collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", 2)]


def test_violations(spark):
    t = frame(spark, [(1, "a"), (1, "b"), (None, "a"), (None, "z")], "k int, v string")
    assert [tuple(r) for r in quality.duplicates(t, ["k"]).collect()] == [(1, 2)]
    assert [tuple(r) for r in quality.outside(t, "v", ["a", "b"]).collect()] == [("z", 1)]
    assert quality.orphans(t, "k", frame(spark, [(2,)], "id int"), "id").count() == 2
    assert tuple(quality.nulls(t, ["k", "v"]).head()) == (2, 0)


def test_similar_names(spark):
    rows = frame(spark, [("GB", "BBC", "a"), ("GB", "BBC News", "b"), ("GB", "b.b.c", "c"), ("FR", "BBC", "d"), ("GB", "新聞", "e")], "iso string, name string, domain string")
    got = {(r.name_a, r.name_b) for r in quality.similar_names(rows, "iso", "name", ["domain", "iso"]).collect()}
    assert got == {("BBC", "BBC News"), ("BBC News", "b.b.c"), ("BBC", "新聞"), ("BBC News", "新聞"), ("b.b.c", "新聞")}


def test_shared_domains(spark):
    rows = frame(spark, [("e.org", "N", "NG"), ("e.org", "C", "CI"), ("f.org", "X", "FR")], "d string, n string, i string")
    assert [tuple(r) for r in quality.shared_domains(rows, "d", "n", "i").collect()] == [("e.org", 2, "C (CI), N (NG)")]


def test_moderation_lines(spark):
    queue = frame(spark, [(10, 1), (11, 2), (12, 3), (13, 4)], "id int, place int")
    lines = frame(spark, list(enumerate(["A", "r", "no feed", "s", "r", ""])), "line_no int, text string")
    got = {r.id: (r.status, r.note) for r in moderation.decisions(queue, lines).collect()}
    assert got == {10: ("approved", None), 11: ("rejected", "no feed"), 13: ("rejected", None)}


def test_moderation_note_that_looks_like_an_answer(spark):
    queue = frame(spark, [(1, 1), (2, 2), (3, 3)], "id int, place int")
    lines = frame(spark, list(enumerate(["r", "r", "r", "a", "a"])), "line_no int, text string")
    got = {r.id: (r.status, r.note) for r in moderation.decisions(queue, lines).collect()}
    assert got == {1: ("rejected", "r"), 2: ("rejected", "a"), 3: ("approved", None)}


def test_validation(spark, news):
    bodies = frame(
        spark,
        [("n", "https://e.org", "https://e.org/f", "ci", "fr"), ("n", "https://e.org", "", "ci", None), ("n", "nothing", "https://e.org/f", "ci", "fr"), ("n", "https://e.org", "https://e.org/f", "zz", "fr")],
        "name string, homepage_url string, feed_url string, country_iso string, language string",
    )
    got = [r.error for r in moderation.validated(bodies, news[0]).collect()]
    assert sorted(map(str, got)) == ["None", "missing: feed_url, language", "not a URL", "unknown country"]


JOBS = '{"items":[{"metadata":{"name":"old","creationTimestamp":"2024-01-01T00:00:00Z","ownerReferences":[{"name":"w"}]},"status":{"succeeded":1}},{"metadata":{"name":"new","creationTimestamp":"2024-01-01T00:10:00Z","ownerReferences":[{"name":"w"}]},"status":{}},{"metadata":{"name":"hand","creationTimestamp":"2024-01-01T00:12:00Z"},"status":{"succeeded":1}}]}'
PODS = '{"items":[{"metadata":{"name":"p"},"status":{"containerStatuses":[{"name":"a","state":{"waiting":{"reason":"CrashLoopBackOff"}}},{"name":"b","state":{"waiting":{"reason":"CrashLoopBackOff"}}}]}},{"metadata":{"name":"q"},"status":{}}]}'


@pytest.mark.parametrize(("minute", "succeeded", "state"), [(11, 0, "running"), (13, 0, "failed"), (29, 1, "ok"), (30, 1, "failed")])
def test_job_state(spark, minute, succeeded, state):
    row = spark.sql(f"SELECT TIMESTAMP '2024-01-01 00:10:00' c, {succeeded} s, TIMESTAMP '2024-01-01 00:{minute}:00' n")
    assert row.select(health.job_state(F.col("c"), F.col("s"), F.col("n"))).head()[0] == state


def test_health(spark):
    jobs = health.jobs(frame(spark, [(JOBS,)], "body string"))
    assert health.latest_job(jobs, "w").head().name == "new"
    missing = health.latest_job(jobs, "x")
    assert missing.select(health.job_state(F.col("created"), F.col("succeeded"), F.current_timestamp())).head()[0] == "missing"
    rows = health.containers(frame(spark, [(PODS,)], "body string"))
    assert (health.crashing_containers(rows).head().n, health.crashing_pods(rows).head().n) == (2, 1)
    checks = frame(spark, [("PASS", "a"), ("FAIL", "b"), ("SKIPPED", "c"), ("FAIL", "a")], "state string, message string")
    assert tuple(health.tally(checks).head()) == (1, 2, 1, False)
    assert tuple(health.alerts(checks).head()) == (2, "a; b")
    assert health.alerts(checks.where("state = 'PASS'")).isEmpty()


def test_snapshot_and_restore(spark, tmp_path):
    t = {"a": frame(spark, [(1, "x")], "k int, v string"), "b": frame(spark, [], "k int")}
    counts = store.snapshot(t, str(tmp_path), "2024")
    back = store.restore(spark, str(tmp_path), "2024", {"a": t["a"].schema})
    assert back["a"].collect() == t["a"].collect()
    assert {r.table: r.n for r in counts.collect()} == {"a": 1, "b": 0}
    assert store.same_counts(counts, counts).isEmpty()


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_of_many_wide_rows(spark, adaptive):
    """Ranges are cut once: counted apart from the rows they would differ, and ids repeat."""
    wide = F.repeat(F.sha2(F.col("id").cast("string"), 256), 2)
    rows = spark.range(0, 1_200_000, 1, 7).select(F.xxhash64("id").alias("k"), (F.col("id") % 1000).alias("day"), wide.alias("wide"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = upsert.with_ids(rows, spark.range(41), ["day", "k"])
        assert got.columns == ["k", "day", "wide", "id"]
        found = got.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.max("id").alias("m"), F.min("id").alias("l")).head()
        assert tuple(found) == (1_200_000, 1_200_000, 1_200_040, 41)
        ordered = got.select("id", F.struct("day", "k").alias("o"), ((F.col("id") - 41) / 1000).cast("int").alias("block"))
        ends = ordered.groupBy("block").agg(F.min("o").alias("first"), F.max("o").alias("last"), F.min_by("o", "id").alias("a"), F.max_by("o", "id").alias("b")).orderBy("block").collect()
        assert all(r.first == r.a and r.last == r.b for r in ends) and all(x.last <= y.first for x, y in zip(ends, ends[1:]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_ids_of_nothing(spark):
    empty = frame(spark, [], "k string")
    assert upsert.with_ids(empty, spark.range(3), ["k"]).count() == 0
    assert [r.id for r in upsert.with_ids(frame(spark, [("a",)], "k string"), empty.withColumn("id", F.lit(1)), ["k"]).collect()] == [1]


def test_upsert_of_repeated_keys(spark):
    old = frame(spark, [(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = frame(spark, [(1, "c", "p", 1), (1, "d", "q", 2), (3, "e", "r", 1), (3, None, "s", 3), (3, "f", "t", 2)], "k int, v string, w string, n int")
    got = sorted(map(tuple, upsert.upsert(old, new, ["k"], ["v"], ["n"]).collect()))
    assert got == [(1, "d", "x"), (2, "b", "y"), (3, None, "r")]  # the first inserts, the last updates
    assert upsert.upsert(old, new.drop("n"), ["k"], ["v", "w"]).count() == 3
    assert upsert.upsert(old, new.select("k"), ["k"], []).count() == 3


def test_registers(spark, tmp_path):
    path = str(tmp_path / "builds")
    for n in (1, 2):
        store.enter(frame(spark, [(n, f"tag{n}")], "number int, tag string"), path)
    assert store.register(spark, path, "number int, tag string").count() == 2
    log = str(tmp_path / "log")
    for n in (1, 2):
        store.note(frame(spark, [(f"| {n} | ok |",)], "line string"), log)
    assert sorted(r.value for r in spark.read.text(log).collect()) == ["| 1 | ok |", "| 2 | ok |"]
    texts = frame(spark, [('{"n": 1}',), ('[{"n": 1}, {"n": 2}]',), ("",), (None,)], "t string")
    got = texts.select(store.as_list(F.col("t"), "struct<n:int>").alias("l")).collect()
    assert [[x.n for x in r.l] for r in got] == [[1], [1, 2], [], []]
    table = str(tmp_path / "table")
    spark.range(3).write.parquet(table)
    store.emptied(spark, table, "id bigint")
    assert [r.id for r in upsert.with_ids(frame(spark, [("a",)], "k string"), spark.read.parquet(table), ["k"]).collect()] == [1]
    for name in ("002_b.sql", "001_a.sql", "note.txt"):
        (tmp_path / name).write_text(f"-- {name}\nSELECT 1;")
    assert [r.name for r in store.statements(spark, str(tmp_path)).collect()] == ["001_a.sql", "002_b.sql"]


def test_similar_names_of_long_names(spark):
    rows = [("g", "x" * 1000 + "news"), ("g", "News"), ("g", "daily"), ("g", "the-daily news"), ("h", "news")]
    got = quality.similar_names(frame(spark, rows, "g string, n string"), "g", "n", ["n"]).collect()
    assert {(r.name_a, r.name_b) for r in got} == {("News", "x" * 1000 + "news"), ("News", "the-daily news"), ("daily", "the-daily news")}


def test_stamp_and_backfill(spark):
    from pressmill.functions.dates import stamp

    row = frame(spark, [(None, "2024-02-03 04:05:06"), ("kept", "2024-02-03 04:05:06")], "c string, t string")
    got = upsert.backfill(row, "c", stamp(F.col("t").cast("timestamp"))).collect()
    assert [r.c for r in got] == ["2024-02-03_04-05-06", "kept"]
