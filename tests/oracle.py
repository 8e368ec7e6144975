"""Runs a query and its SQL over the smallest tables."""

from functools import lru_cache
from pathlib import Path

import duckdb

from compare import rows_of

FOLDER = "/root/testdata/sf0.001"


@lru_cache(maxsize=1)
def connection():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def assert_same(spark, query, sql):
    df = query(spark, FOLDER)
    cur = connection().execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())
