"""Compare registered queries with their SQL twins on DuckDB. Usage: python tests/oracle.py [folder] [name ...]"""
from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is not None, str(type(x)) if x is None else "", str(x)) for x in r))


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - t0
    names, a = rows(df.columns, [tuple(r) for r in got])
    if sql is None:
        return f"ROWS {len(a)}", took
    cur = con.execute(sql)
    names2, b = rows([c[0] for c in cur.description], cur.fetchall())
    if names != names2:
        return f"COLUMNS {names} vs {names2}", took
    if len(a) != len(b):
        return f"COUNT {len(a)} vs {len(b)}", took
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        near = all(all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-6))
                       for p, q in zip(x, y)) for x, y in bad)
        return f"VALUES {len(bad)}/{len(a)}{' (float noise)' if near else ''} {names} {bad[0][0]} vs {bad[0][1]}", took
    if not a:
        return "EMPTY", took
    return f"OK {len(a)}", took


def main():
    from tidemark.session import local_session
    import __spark_entry__ as e
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    q, s = e.queries(), e.oracle_sql()
    fails = 0
    for name, fn in q.items():
        if wanted and name not in wanted:
            continue
        try:
            res, took = compare(spark, con, folder, name, fn, s.get(name))
        except Exception as ex:  # noqa: BLE001
            res, took = f"ERROR {type(ex).__name__}: {str(ex)[:900]}", 0
        fails += not res.startswith(("OK", "ROWS"))
        print(f"{name:32s} {took:6.2f}s {res}", flush=True)
    print("failures:", fails, "of", len(q))


if __name__ == "__main__":
    main()
