"""Compare a Spark query with its DuckDB oracle the way the driver does:
row count, column names, and an order-insensitive multiset of row values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if v is None:
        return None
    if isinstance(v, (int, str, bool)):
        return v
    return str(v)


def compare(spark_df, con, sql: str) -> dict:
    s_rows = [tuple(r) for r in spark_df.collect()]
    s_cols = list(spark_df.columns)
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_cols": s_cols, "oracle_cols": d_cols}
    out["cols_match"] = sorted(s_cols) == sorted(d_cols)
    if out["cols_match"]:
        order = [d_cols.index(c) for c in s_cols]
        d_rows = [tuple(r[i] for i in order) for r in d_rows]
    sc = Counter(tuple(_norm(v) for v in r) for r in s_rows)
    dc = Counter(tuple(_norm(v) for v in r) for r in d_rows)
    out["values_match"] = sc == dc
    if not out["values_match"]:
        out["only_spark"] = list((sc - dc).elements())[:5]
        out["only_oracle"] = list((dc - sc).elements())[:5]
    out["ok"] = out["cols_match"] and out["values_match"] and len(s_rows) == len(d_rows)
    return out
