"""Compare named queries with their DuckDB twins.  ``python tests/compare.py [names]``"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, decimal.Decimal):
        return ("dec", str(x))
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, folder, name, plan, sql):
    """None when equal, else what differs."""
    df = plan(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = rows_of(names, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        only = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} != {len(want)}; spark only {list(only[0])[:2]}; sql only {list(only[1])[:2]}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return f"{len(diff)} of {len(got)} rows differ {got_cols}\n   spark {diff[0][0]}\n   sql   {diff[0][1]}"
    return None if got else "no rows on either side"


def main():
    import __spark_entry__ as e
    from neraca.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    plans, sqls = e.queries(), e.oracle_sql()
    picked = [a for a in sys.argv[1:] if not a.startswith("^")]
    starts = [a[1:] for a in sys.argv[1:] if a.startswith("^")]
    names = [n for n in plans if not (picked or starts) or n in picked or any(n.startswith(s) for s in starts)]
    bad = 0
    for name in names:
        t = time.time()
        try:
            problem = compare(spark, con, folder, name, plans[name], sqls.get(name))
        except Exception as ex:  # noqa: BLE001
            problem = f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += problem is not None
        tag = "ok " if problem is None else "BAD"
        print(f"{tag} {name} {time.time() - t:.1f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
