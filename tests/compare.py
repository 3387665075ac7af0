"""Run registered queries and their SQL side by side.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def as_bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(cell(row[i]) for i in order) for row in rows)


def difference(frame, connection, sql: str) -> str | None:
    """None when both give the same bag of rows under the same column names."""
    spark_columns, spark_rows = as_bag(frame.columns, frame.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    duck_columns, duck_rows = as_bag(names, result.fetchall())
    if spark_columns != duck_columns:
        return f"columns {spark_columns} != {duck_columns}"
    if spark_rows != duck_rows:
        only_spark, only_duck = spark_rows - duck_rows, duck_rows - spark_rows
        show = lambda bag: [tuple(str(c)[-160:] for c in row) for row in list(bag)[:2]]
        return (
            f"rows {sum(spark_rows.values())} vs {sum(duck_rows.values())}; only spark "
            f"{sum(only_spark.values())}: {show(only_spark)}; only sql {sum(only_duck.values())}: {show(only_duck)}"
        )
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from stellwerk.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles = duck(sf), entry.oracle_sql()
    bad = 0
    for name in wanted:
        started = time.time()
        try:
            frame = entry.queries()[name](spark, sf)
            note = difference(frame, connection, oracles[name]) if name in oracles else f"no sql, {frame.count()} rows"
        except Exception as error:  # noqa: BLE001
            note = f"{type(error).__name__}: {str(error)[:700]}"
        bad += note is not None and not note.startswith("no sql")
        print(f"{name:24s} {time.time() - started:6.2f}s  {note or 'same'}", flush=True)
    print(f"{len(wanted)} queries, {bad} differ")
