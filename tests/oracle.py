"""Run registered queries beside their SQL and compare whole results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb
import numpy as np

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a short description."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got is not None else "no rows", len(got)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    for g, w in zip(got, want):
        if g != w:
            return f"{sorted(cols)} {g} vs {w}", len(got)
    return None, len(got)


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = database(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or n in names or any(x.endswith("*") and n.startswith(x[:-1]) for x in names)]
    for n in chosen:
        start = time.time()
        try:
            problem, count = compare(spark, con, n, queries[n], oracles.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, count = f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {n:34s} {count:8d} {time.time() - start:6.1f}s {'sql' if n in oracles else 'rows'} {problem or ''}"[:900], flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} good")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
