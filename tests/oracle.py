"""Compare registered Spark queries with their SQL twins on the supplied tables."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, builder, sql, sf_dir):
    t0 = time.time()
    df = builder(spark, sf_dir)
    got, gcols = canonical(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t0
    if sql is None:
        return True, f"{len(got)} rows (no twin)", spent
    cur = con.execute(sql)
    want, wcols = canonical([d[0] for d in cur.description], cur.fetchall())
    if gcols != wcols:
        return False, f"columns {gcols} != {wcols}", spent
    if got != want:
        g, w = set(got), set(want)
        return False, f"rows {len(got)} vs {len(want)}; spark-only {sorted(g - w)[:2]} sql-only {sorted(w - g)[:2]}", spent
    return True, f"{len(got)} rows", spent


if __name__ == "__main__":
    import __spark_entry__ as entry
    from metaloom.session import local_session

    sf = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    wanted = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note, spent = compare(spark, con, name, fn, oracle.get(name), sf)
        except Exception as exc:  # report and go on
            ok, note, spent = False, f"{type(exc).__name__}: {str(exc)[:600]}", 0.0
        bad += not ok
        print(("ok  " if ok else "FAIL"), name, f"{spent:.1f}s", note, flush=True)
    print("failures:", bad)
    spark.stop()
