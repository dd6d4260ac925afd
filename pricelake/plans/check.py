"""Run registered queries against their DuckDB oracle and compare results.

Rows are compared as multisets after normalizing values (floats to 6 decimals, dates and
timestamps to ISO text), column names as sorted sets, the way the driver's gate compares them.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from pricelake.sources.tables import TEST_TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, name: str, fn, sql: str, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    s_cols = df.columns
    out = {"query": name, "spark_rows": len(s_rows), "oracle_rows": len(o_rows),
           "cols_match": sorted(s_cols) == sorted(o_cols), "spark_sec": round(t1 - t0, 2)}
    out["values_match"] = out["cols_match"] and _rows(s_cols, s_rows) == _rows(o_cols, o_rows)
    if not out["values_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, o_cols
        if out["cols_match"]:
            a, b = _rows(s_cols, s_rows), _rows(o_cols, o_rows)
            sa, sb = set(a), set(b)
            out["only_spark"] = [r for r in a if r not in sb][:3]
            out["only_oracle"] = [r for r in b if r not in sa][:3]
    return out


def main(argv: list[str]) -> int:
    from pricelake.plans.registry import oracle_sql, queries
    from pricelake.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf_dir = a[5:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            print({"query": name, "rows": df.count(), "oracle": None}, flush=True)
            continue
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls[name], con)
        except Exception as e:  # report and continue
            r = {"query": name, "error": repr(e)[:600]}
        bad += not r.get("values_match")
        print(r, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
