"""Run queries beside their DuckDB text and report differences.

usage: python tests/compare.py [folder] [name ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "item"):
        return canon(v.item())
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, query, sql, folder):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows={len(got)}", True
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", False
    if got == want:
        return f"rows={len(got)}", True
    only_got = [r for r in got if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(got)][:2]
    return f"rows {len(got)} vs {len(want)}\n   spark {str(only_got)[:900]}\n   duck  {str(only_want)[:900]}", False


def connect(folder):
    import duckdb
    from gleaner.plans.fixtures import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from gleaner.plans.registry import oracle_sql, queries
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    qs, sqls, bad = queries(), oracle_sql(), []
    spark, con = session(), connect(folder)
    names = sys.argv[2:] or list(qs)
    for n in names:
        t0 = time.time()
        try:
            note, ok = compare(spark, con, n, qs[n], sqls.get(n), folder)
        except Exception as e:  # report and go on
            note, ok = f"{type(e).__name__} {str(e)[:1500]}", False
        if not ok:
            bad.append(n)
        print(("ok  " if ok else "BAD ") + f"{n:26s} {time.time() - t0:6.2f}s {'' if n in sqls else '(no sql) '}{note}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {bad}")
