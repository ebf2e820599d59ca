"""Runs registered queries on Spark and their SQL on DuckDB and compares whole results.

As a script: ``python tests/compare.py <sf_dir> [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _sortable(row: tuple) -> tuple:
    return tuple((v is None, str(type(v).__name__ == "str"), v if v is not None else 0) for v in row)


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=_sortable)


def difference(spark_columns, spark_rows, sql_columns, sql_rows) -> str | None:
    """None if both results are equal value by value, else what differs."""
    if sorted(spark_columns) != sorted(sql_columns):
        return f"columns {sorted(spark_columns)} / {sorted(sql_columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    ours, theirs = _rows(spark_columns, spark_rows), _rows(sql_columns, sql_rows)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ, first {sorted(spark_columns)}: {wrong[0]}"
    signs = [r for r in ours + theirs for v in r if isinstance(v, float) and v == 0 and math.copysign(1, v) < 0]
    return f"negative zero in {signs[0]}" if signs else None


SAME_TYPE = {"DOUBLE": "double", "INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean"}


def type_difference(df, answer) -> str | None:
    """None if every column has the corresponding type on both sides."""
    ours = dict(df.dtypes)
    wrong = [(d[0], ours.get(d[0]), str(d[1])) for d in answer.description if SAME_TYPE.get(str(d[1])) != ours.get(d[0])]
    return f"types {wrong}" if wrong else None


def check(spark, con, name: str, sf_dir: str, queries, oracle) -> str | None:
    df = queries[name](spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    answer = con.execute(oracle[name])
    columns = [d[0] for d in answer.description]
    return type_difference(df, answer) or difference(df.columns, ours, columns, answer.fetchall())


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, oracle = entry.queries(), entry.oracle_sql()
    con, failed = duck(sf_dir), 0
    for name in names or oracle:
        t = time.time()
        try:
            problem = check(spark, con, name, sf_dir, queries, oracle)
        except Exception as err:  # report and go on with the next query
            problem = str(err)[:400].replace("\n", " ")
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok'} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
