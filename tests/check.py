"""Compare registered queries with their SQL oracle: python tests/check.py [sf] [name ...]."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


def oracle_rows(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(names), rows_of(names, cursor.fetchall())


def compare(df, sf_dir, sql):
    """None if equal, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    names, want = oracle_rows(sf_dir, sql)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} != {names}"
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {str(bad[0])[:600]}" if bad else None


def main():
    import __spark_entry__ as entry

    from retinue.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    plans, oracles = entry.queries(), entry.oracle_sql()
    sf_dir = f"/root/testdata/sf{sf}"
    failed = 0
    for name in sys.argv[2:] or plans:
        start = time.time()
        try:
            problem = compare(plans[name](spark, sf_dir), sf_dir, oracles.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        spark.catalog.clearCache()
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name} {'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
