"""Runs registered queries in Spark and DuckDB and compares them, as a script or from pytest."""

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(t[i]) for i in order) for t in data])


def compare(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    got = rows(df.columns, [tuple(x) for x in df.collect()])
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return len(got), None
    a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return len(got), f"rows {len(got)} vs {len(want)}, {len(a)} differ {sorted(names)}:\n     got  {a[:3]}\n     want {b[:3]}"


def main(argv):
    from barwright.session import local_session
    from barwright import catalog
    sf = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, name, fn, catalog.ORACLES.get(name), sf)
        except Exception as e:
            n, err = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += err is not None
        sqlnote = "" if name in catalog.ORACLES else " (no SQL)"
        print(f"{'ok  ' if err is None else 'FAIL'} {name} n={n} {time.time() - t:.1f}s{sqlnote}" + (f"\n     {err}" if err else ""), flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
