"""Compare registered queries with their SQL counterparts.

Usage: python tests/check.py SF_DIR [PREFIX ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, build, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = build(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if df.columns else "no columns"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if mine != theirs:
        a = [r for r in mine if r not in set(theirs)][:2] if len(mine) < 20000 else mine[:2]
        b = [r for r in theirs if r not in set(mine)][:2] if len(mine) < 20000 else theirs[:2]
        return f"rows {len(mine)} vs {len(theirs)}; only spark {a}; only sql {b}"
    if not mine:
        return "EMPTY result"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    con, oracle, bad = connect(sf_dir), e.oracle_sql(), 0
    for name, build in e.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            problem = compare(spark, con, build, oracle.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - a report, not control flow
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        tag = "ok" if problem is None else "BAD"
        kind = "sql" if name in oracle else "rows"
        print(f"{tag:4}{kind:5}{time.time() - began:6.1f}s {name} {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
