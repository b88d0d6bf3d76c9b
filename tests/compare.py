"""Run registered queries and their SQL side by side: python -m tests.compare [sf] [name ...]."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """A comparable form: numbers as rounded floats, containers as tuples."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else float(f"{number:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    took = time.time() - started
    if sql is None:
        return "rows only", len(rows), took, None
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = table(columns, result.fetchall())
    got = table(df.columns, rows)
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", len(rows), took, (sorted(df.columns), sorted(columns))
    if got != want:
        only = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return "DIFFER", len(rows), took, (len(got), len(want), only)
    return ("same" if got else "EMPTY"), len(rows), took, None


def main() -> int:
    import __spark_entry__ as driver
    from snipdex.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    sql = driver.oracle_sql()
    for name, fn in driver.queries().items():
        if sys.argv[2:] and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in sys.argv[2:]):
            continue
        try:
            state, n, took, why = compare(spark, con, sf_dir, name, fn, sql.get(name))
        except Exception as e:  # keep going: one report for all queries
            state, n, took, why = "ERROR", 0, 0.0, str(e)[:1500]
        bad += state not in ("same", "rows only")
        print(f"{name:28} {state:10} {n:7} {took:6.2f}s", why if why else "", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
