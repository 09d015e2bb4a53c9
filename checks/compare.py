"""Run every registered report in Spark and in DuckDB on the same tables and compare the rows.

    python -m checks.compare [folder] [report ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from tillpath.plans.catalog import CATALOG
from tillpath.session import builder


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    """A DuckDB connection with one view per table."""
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(
    spark: SparkSession, con: duckdb.DuckDBPyConnection, folder: str, name: str
) -> str | None:
    """What differs between the two answers of a report, or None."""
    found = CATALOG[name](spark, folder)
    answer = con.execute(oracle_sql()[name])
    expected_columns = [d[0] for d in answer.description]
    if sorted(found.columns) != sorted(expected_columns):
        return f"columns {sorted(found.columns)} against {sorted(expected_columns)}"
    ours = _rows(found.columns, [tuple(r) for r in found.collect()])
    theirs = _rows(expected_columns, answer.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"row {a} against {b}"
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CATALOG)
    spark = (
        builder("compare")
        .master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(folder)
    failed = 0
    for name in names:
        start = time.perf_counter()
        problem = difference(spark, con, folder, name)
        failed += problem is not None
        print(f"{name:36s} {time.perf_counter() - start:6.2f} s  {problem or 'equal'}", flush=True)
    spark.stop()
    print(f"{len(names) - failed} of {len(names)} equal")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
