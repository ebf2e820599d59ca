"""Result sinks and the compute-once table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException


def materialise(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Read ``path`` if an earlier run wrote it, else compute and write it.

    A folder without data, as a crashed run leaves it, is written over.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    df = compute()
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """All rows with a header line per file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_output_series(output: DataFrame, path: str, fmt: str = "csv") -> None:
    """Constant-price output ordered by (geo, year)."""
    writer = output.orderBy("geo", "year").write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}; use 'csv' or 'parquet'")


def write_tables(tables: Mapping[str, DataFrame], prefix: str, mode: str = "overwrite") -> None:
    """Save each named table as ``<prefix><name>`` in the catalog."""
    for name, df in tables.items():
        df.write.mode(mode).saveAsTable(f"{prefix}{name}")
