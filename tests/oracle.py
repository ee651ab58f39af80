"""Run a query in Spark and its SQL in DuckDB on the same tables and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if hasattr(v, "is_finite"):
        return float(v)
    return v


def _rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str, limit: int = 3) -> list[str]:
    """Empty when names, row counts and values agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    want = _rows(names, cur.fetchall())
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(got) != len(want):
        return [f"{len(got)} rows, expected {len(want)}", f"got {got[:2]}", f"want {want[:2]}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return [f"{len(bad)} of {len(want)} rows differ"] + [f"got {g}\n    want {w}" for g, w in bad[:limit]] if bad else []
