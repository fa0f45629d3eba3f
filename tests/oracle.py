"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in records), key=repr), [names[i] for i in order]


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, folder, name, fn, sql, con):
    df = fn(spark, folder)
    got, got_names = rows_of([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    want, want_names = rows_of(cur.fetchall(), [d[0] for d in cur.description])
    if got_names != want_names:
        return len(got), f"columns {got_names} != {want_names}"
    if got != want:
        gs, ws = set(got), set(want)
        extra, missing = [r for r in got if r not in ws][:3], [r for r in want if r not in gs][:3]
        return len(got), f"{len(got)} rows != {len(want)}; extra {extra}; missing {missing}"
    return len(got), None


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = make_session()
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        start = time.time()
        try:
            n, problem = compare(spark, folder, name, fn, oracle.get(name), con)
        except Exception as error:  # report and go on
            n, problem = -1, f"{type(error).__name__}: {str(error)[:700]}"
        mark = "ok " if problem is None else "BAD"
        bad += problem is not None
        print(f"{mark} {name} rows={n} {time.time() - start:.2f}s {'' if name in oracle else '(no sql)'} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
