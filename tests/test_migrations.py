import threading

import pytest

from pressmill.sources import migrations


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


@pytest.fixture
def names(spark):
    yield ["m_publishers", "m_feeds"]
    for t in ("m_publishers", "m_feeds"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


FIRST = "-- tables;\nCREATE TABLE IF NOT EXISTS m_publishers (id INT, name STRING) USING parquet;\nCREATE TABLE IF NOT EXISTS m_feeds (id INT, feed_type STRING DEFAULT 'rss') USING parquet;\n"


def test_files_are_run_once_and_in_order(spark, tmp_path, names):
    folder, ledger = tmp_path / "sql", str(tmp_path / "ledger")
    put(folder, "001_init.sql", FIRST)
    go = lambda **more: migrations.migrate(spark, str(folder), ledger, **more)
    assert go() == ["001_init.sql"] and go() == []
    spark.sql("INSERT INTO m_publishers VALUES (1, 'a'), (2, 'b')")
    spark.sql("INSERT INTO m_feeds (id) VALUES (7)")
    put(folder, "003_status.sql", "ALTER TABLE m_publishers ADD COLUMNS (feed_status STRING DEFAULT 'active');")
    put(folder, "002_domain.sql", "ALTER TABLE m_publishers ADD COLUMNS (domain STRING)")
    assert go() == ["002_domain.sql", "003_status.sql"] and go() == []
    spark.sql("INSERT INTO m_publishers VALUES (3, 'c', 'c.org', 'pending')")
    got = sorted(tuple(r) for r in spark.table("m_publishers").collect())
    assert got == [(1, "a", None, "active"), (2, "b", None, "active"), (3, "c", "c.org", "pending")]  # old rows under the new schema
    assert [r.feed_type for r in spark.table("m_feeds").collect()] == ["rss"]


def test_changed_files_are_refused(spark, tmp_path, names):
    folder, ledger = tmp_path / "sql", str(tmp_path / "ledger")
    put(folder, "001_init.sql", FIRST)
    migrations.migrate(spark, str(folder), ledger)
    put(folder, "001_init.sql", FIRST + "-- and more")
    put(folder, "002_more.sql", "DROP TABLE m_feeds")
    with pytest.raises(migrations.Changed, match="001_init"):
        migrations.migrate(spark, str(folder), ledger)
    assert spark.catalog.tableExists("m_feeds")
    (folder / "001_init.sql").unlink()
    with pytest.raises(migrations.Changed):
        migrations.migrate(spark, str(folder), ledger)


def test_rules_and_failures(spark, tmp_path, names):
    folder, ledger = tmp_path / "sql", str(tmp_path / "ledger")
    rules = {"m_publishers": {"named": "name IS NOT NULL", "known_status": "feed_status IN ('active', 'pending')"}, "m_none": {"x": "y = 1"}}
    put(folder, "001_init.sql", FIRST + "INSERT INTO m_publishers VALUES (1, NULL), (2, 'b'), (3, NULL);")
    with pytest.raises(migrations.Broken, match="named.*2"):
        migrations.migrate(spark, str(folder), ledger, rules)
    assert migrations.applied(spark, ledger) == {}
    put(folder, "001_init.sql", "TRUNCATE TABLE m_publishers;\n" + FIRST)  # put right, and run from its beginning
    assert migrations.migrate(spark, str(folder), ledger, rules) == ["001_init.sql"]
    put(folder, "002_bad.sql", "SELECT nonsense FROM nowhere")
    with pytest.raises(Exception, match="nowhere"):
        migrations.migrate(spark, str(folder), ledger, rules, seconds=2)
    put(folder, "002_bad.sql", "ALTER TABLE m_publishers ADD COLUMNS (feed_status STRING DEFAULT 'new');\nINSERT INTO m_publishers VALUES (9, 'z', DEFAULT)")
    with pytest.raises(migrations.Broken, match="known_status"):
        migrations.migrate(spark, str(folder), ledger, rules, seconds=2)


def test_two_runners_at_once(spark, tmp_path, names):
    folder, ledger, got = tmp_path / "sql", str(tmp_path / "ledger"), []
    put(folder, "001_init.sql", FIRST + "INSERT INTO m_publishers VALUES (1, 'a');")
    threads = [threading.Thread(target=lambda: got.append(migrations.migrate(spark, str(folder), ledger))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [[], [], ["001_init.sql"]] and spark.table("m_publishers").count() == 1
