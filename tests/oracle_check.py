"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
Prints one line per query and a summary; exit code 1 on any mismatch.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tabqa.sources.tables import TABLE_NAMES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict(recursive=True))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def duck_conn(sf_dir):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    scols = df.columns
    srows = [tuple(norm(x) for x in r) for r in df.collect()]
    ts = time.time() - t0
    if sql is None:
        return "rows-only", f"{len(srows)} rows", ts, 0.0
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [tuple(norm(x) for x in r) for r in res.fetchall()]
    td = time.time() - t1
    if sorted(scols) != sorted(dcols):
        return "COLS", f"spark={scols} duck={dcols}", ts, td
    order = [dcols.index(c) for c in scols]
    drows = [tuple(r[i] for i in order) for r in drows]
    if len(srows) != len(drows):
        return "COUNT", f"spark={len(srows)} duck={len(drows)}", ts, td
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a, b = sorted(srows, key=key), sorted(drows, key=key)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return "VALUES", f"{diff}", ts, td
    return "ok", f"{len(srows)} rows", ts, td


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    prefixes = argv[2:]
    from tabqa.session import get_session
    import __spark_entry__ as E

    spark = get_session()
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck_conn(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            status, msg, ts, td = compare(spark, con, name, fn, os_.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            status, msg, ts, td = "ERROR", repr(e)[:400], 0.0, 0.0
        if status not in ("ok", "rows-only"):
            bad += 1
        print(f"{status:9s} {name:32s} spark={ts:6.2f}s duck={td:6.2f}s {msg[:300]}", flush=True)
    print(f"SUMMARY bad={bad} total={len(qs)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
