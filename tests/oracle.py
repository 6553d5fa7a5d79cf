"""Runs SQL on the same tables in DuckDB, for comparison."""

import glob
import os

import duckdb


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def _shown(value):
    return repr(round(value, 6)) if isinstance(value, float) else repr(value)


def same(df, sf_dir: str, sql: str) -> None:
    names, rows = sql_rows(sf_dir, sql)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    mine = sorted(tuple(_shown(r[c]) for c in columns) for r in df.collect())
    other = sorted(tuple(_shown(r[i]) for i in place) for r in rows)
    assert mine == other
