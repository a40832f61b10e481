"""Run registered queries and compare them with their SQL: python tests/compare.py SF_DIR [NAME ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def _rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, name: str, sf_dir: str) -> tuple[str, int, float]:
    """Outcome, number of rows and seconds of the Spark query."""
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "no sql", len(got), seconds
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got), seconds
    left, right = _rows(df.columns, got), _rows(columns, want)
    if left == right:
        return "ok", len(got), seconds
    a, b = set(map(repr, left)), set(map(repr, right))
    only_left, only_right = sorted(a - b)[:2], sorted(b - a)[:2]
    return (
        f"differs: {len(left)} and {len(right)} rows, {len(a - b)} only in Spark, {len(b - a)} only in SQL\n"
        f"  {sorted(columns)}\n  spark {only_left}\n  sql   {only_right}"
    ), len(got), seconds


def main() -> int:
    from lanternlog.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        try:
            outcome, rows, seconds = compare(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            outcome, rows, seconds = f"{type(error).__name__}: {str(error)[:600]}", -1, 0.0
        failed += outcome not in ("ok", "no sql")
        print(f"{name:28s} {rows:7d} {seconds:6.1f}s {outcome}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
