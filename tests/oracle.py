"""Compares registered queries with their oracle SQL on the given tables.

    python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def family(type_name: str) -> str:
    n = str(type_name).lower()
    if n in ("tinyint", "smallint", "int", "integer", "bigint", "long"):
        return {"integer": "int", "bigint": "long"}.get(n, n)
    return {"varchar": "string"}.get(n, n)


def norm(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """(problem or None, rows)"""
    df = fn(spark, sf_dir)
    got_types = {n: family(t) for n, t in df.dtypes}
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want_types = {d[0]: family(d[1]) for d in res.description}
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    if got_types != want_types:
        diff = {k: (got_types[k], want_types[k]) for k in got_types if got_types[k] != want_types[k]}
        return f"types (spark, oracle): {diff}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}; first {got[:2]} / {want[:2]}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ in {sorted(cols)}, e.g. {bad[0][0]} / {bad[0][1]}", len(got)
    return None, len(got)


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE", "8"))
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = e.oracle_sql()
    failed = 0
    for name, fn in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - a report, not a handler
            problem, n = f"{type(exc).__name__}: {str(exc)[:900]}", -1
        failed += problem is not None
        state = "FAIL " + problem if problem else ("ok" if name in oracles else "ok (rows only)")
        print(f"{name:32s} {n:7d} rows {time.time() - start:6.2f}s {state}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
