"""Run a query on Spark and its twin on DuckDB and compare names, types of value, and rows."""

from __future__ import annotations

import datetime as dt
import math
import time
from collections import Counter
from decimal import Decimal

import duckdb

TIMES: dict[str, float] = {}
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v)) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.astimezone(dt.UTC).replace(tzinfo=None)
    return v


def kind(v) -> str:
    return type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def type_differences(df, con, sql: str) -> list[str]:
    """Columns whose Spark type is not the DuckDB type of the same name."""
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"{n}: {got[n]} vs {want.get(n)}" for n in got
            if SAME_TYPE.get(got[n], got[n]) != want.get(n)]


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    t0 = time.time()
    cur = con.execute(sql)
    TIMES["duckdb"] = time.time() - t0
    want_names = [d[0] for d in cur.description]
    names, want = rows_of(want_names, cur.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if names != got_names:
        return f"columns {got_names} vs {names}"
    kinds = [{kind(r[i]) for r in side if r[i] is not None} for side in (got, want)
             for i in range(len(names))]
    half = len(names)
    for i, n in enumerate(names):
        if kinds[i] and kinds[half + i] and kinds[i] != kinds[half + i]:
            return f"type of {n}: {kinds[i]} vs {kinds[half + i]}"
    if got != want:
        return (f"rows {sum(got.values())} vs {sum(want.values())}; "
                f"only spark {list((got - want).items())[:3]}; "
                f"only duckdb {list((want - got).items())[:3]}")
    return None
