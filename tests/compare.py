"""Run registered queries on Spark and their SQL on DuckDB over the same files, and compare values.

    python -m tests.compare [--sf 0.01] [prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("rollcall")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0):
        return v.date()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def close(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or abs(a - b) <= 1e-12 * max(abs(a), abs(b), 1)
    return a == b


def compare(df, con, oracle: str) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    cur = con.execute(oracle)
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"

    def key(r):
        return tuple((v is not None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r)

    got.sort(key=key)
    want.sort(key=key)
    bad = [(g, w) for g, w in zip(got, want) if not all(close(x, y) for x, y in zip(g, w))]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, {cols}: {bad[:3]}"
    dtypes = dict(df.dtypes)
    kinds = {c: type(next((r[i] for r in want if r[i] is not None), None)) for i, c in enumerate(cols)}
    odd = [(c, dtypes[c], kinds[c].__name__) for c in cols
           if kinds[c] in (int, float) and (dtypes[c] == "double") != (kinds[c] is float)
           and not (kinds[c] is int and dtypes[c] == "double")]
    return f"types {odd}" if odd else None


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("prefix", nargs="*")
    a = ap.parse_args(argv)
    from rollcall.plans.catalog import QUERIES, SQL
    sf_dir = f"/root/testdata/sf{a.sf}"
    spark, con = session(), connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if a.prefix and not any(name.startswith(p) for p in a.prefix):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in SQL:
                problem = compare(df, con, SQL[name])
                n = ""
            else:
                problem, n = None, f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", ""
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {n} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
