"""Holds a query's rows against its SQL, as sorted text of all values by column name."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def text(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def same(spark, con, query, sql):
    got = query(spark, str(DATA))
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(names, cur.fetchall())
