"""Compare registered queries with their SQL in DuckDB. Usage: python -m tests.oracle [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [str(x) for x in r])


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short text saying what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if not a:
        return "no rows"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:2]} / {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(df.columns)}; first {bad[0]}"
    return None


def main(argv):
    import __spark_entry__ as entry

    from trainframe.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    if argv and os.path.isdir(argv[0]):
        sf_dir = argv.pop(0)
    spark = build_session("oracle", "local[8]", 8)
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    import importlib

    argv = [n for a in argv for n in (importlib.import_module(a).QUERIES if a.startswith("trainframe.") else [a])]
    names = argv or list(queries)
    failed = 0
    for name in names:
        t = time.time()
        try:
            msg = compare(spark, con, sf_dir, queries[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            msg = f"{type(e).__name__}: {str(e)[:400]}"
        failed += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t:.1f}s {'' if name in sqls else '(rows only) '}{msg or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
