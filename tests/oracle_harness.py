"""Run a registered Spark query and its DuckDB oracle and compare them.

Comparison: same column names (sorted), same row count, same multiset
of rows after sorting; floats equal within 1e-9 relative. Types are
reported as Arrow types so int32 / int64 mismatches are visible.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return round(v, 9)
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, str(type(v).__name__), v) for v in row)


def rows_of(table: pa.Table) -> list[tuple]:
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    rows = [tuple(_norm(v) for v in r) for r in zip(*data)] if data else []
    return sorted(rows, key=_key)


def compare(spark, name: str, sf_dir: str) -> dict:
    from churnlab.plans.catalog import QUERIES
    from churnlab.plans.oracle import SQL

    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_tab = sdf.toArrow()
    t1 = time.time()
    con = duck(sf_dir)
    d_tab = con.sql(SQL[name]).to_arrow_table()
    t2 = time.time()
    s_types = {f.name: str(f.type) for f in s_tab.schema}
    d_types = {f.name: str(f.type) for f in d_tab.schema}
    out = {
        "name": name,
        "spark_rows": s_tab.num_rows,
        "oracle_rows": d_tab.num_rows,
        "spark_sec": round(t1 - t0, 2),
        "oracle_sec": round(t2 - t1, 2),
        "names_match": sorted(s_types) == sorted(d_types),
        "type_diffs": {k: (s_types.get(k), d_types.get(k)) for k in set(s_types) | set(d_types) if s_types.get(k) != d_types.get(k)},
    }
    if out["names_match"]:
        sr, dr = rows_of(s_tab), rows_of(d_tab)
        out["values_match"] = sr == dr
        if not out["values_match"]:
            diff_s = [r for r in sr if r not in set(dr)][:3]
            diff_d = [r for r in dr if r not in set(sr)][:3]
            out["example_spark_only"] = diff_s
            out["example_oracle_only"] = diff_d
    else:
        out["values_match"] = False
    out["ok"] = out["names_match"] and out["values_match"] and out["spark_rows"] == out["oracle_rows"]
    return out


if __name__ == "__main__":
    from churnlab.plans.catalog import NO_ORACLE, QUERIES
    from churnlab.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or [n for n in QUERIES if n not in NO_ORACLE]
    spark = local_session(8, 8)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "ok": False, "error": repr(e)[:400]}
        bad += not r["ok"]
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
