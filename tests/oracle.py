"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

from graphloom.plans.corpus import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), _bag(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), _bag(columns, cursor.fetchall())


def difference(df, con, sql) -> str | None:
    """What differs between a query and its SQL, None if nothing does."""
    got_columns, got = spark_rows(df)
    want_columns, want = sql_rows(con, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got == want:
        return None
    extra, missing = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
    return f"{len(got)} rows, wanted {len(want)}; extra {extra}; missing {missing}"
