"""Compare registered queries with their SQL: `python tests/oracle.py [sf_dir] [name ...]`."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, text: str) -> str | None:
    """None if the rows agree, else what differs first."""
    mine = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(text)
    theirs = _sorted([c[0] for c in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows against {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(wrong)} of {len(mine[1])} rows, first {wrong[0]}" if wrong else None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.log.level", "ERROR")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    con, checks, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        started = time.perf_counter()
        try:
            df = run(spark, sf_dir)
            found = differences(df, con, checks[name]) if name in checks else f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            found = f"ERROR {type(error).__name__}: {str(error)[:400]}"
        ok = found is None or found.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {time.perf_counter() - started:6.2f}s {name} {found or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
