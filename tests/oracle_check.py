"""Run registered queries beside their SQL and compare rows. ``python tests/oracle_check.py [names...]``"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from driftline.session import local_session  # noqa: E402

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        if isinstance(v, bool):
            return str(v)
        if v is None:
            return "NULL"
        return repr(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    rows = df.collect()
    mine = canonical(df.columns, [tuple(r) for r in rows])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = canonical(cols, cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}", len(rows)
    if mine[1] != theirs[1]:
        only_l = [r for r in mine[1] if r not in set(theirs[1])][:3]
        only_r = [r for r in theirs[1] if r not in set(mine[1])][:3]
        return f"rows {len(mine[1])} vs {len(theirs[1])}\n   spark {only_l}\n   sql   {only_r}", len(rows)
    return None, len(rows)


def main(argv):
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in argv or qs:
        start = time.time()
        try:
            if name in sqls:
                problem, n = compare(spark, con, name, qs[name], sqls[name], sf)
            else:
                problem, n = None, qs[name](spark, sf).count()
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:300]}", -1
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} rows={n} {time.time() - start:.1f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
