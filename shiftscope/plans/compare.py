"""Order-insensitive result comparison used by the oracle harness/tests."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest()[:16], keyed


def compare(spark_df, con, sql):
    """(ok, detail) for a Spark DataFrame against an oracle SQL string."""
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    if sorted(scols) != sorted(ocols):
        return False, f"columns {scols} vs {ocols}"
    if len(srows) != len(orows):
        return False, f"rows {len(srows)} vs {len(orows)}"
    hs, ks = digest(scols, srows)
    ho, ko = digest(ocols, orows)
    if hs != ho:
        diff = sorted(set(ks) - set(ko))[:2] + ["<spark|oracle>"] + sorted(set(ko) - set(ks))[:2]
        return False, "values differ: " + " | ".join(d[:200] for d in diff)
    return True, f"{len(srows)} rows"
