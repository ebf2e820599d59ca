"""Loss tables: cumulative by hazard and annual totals, both wide by country."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Hazard column titles -> canonical hazard names.
HAZARD_COLUMNS = {
    "geotechnical": "geotechnical",
    "meteorological": "meteorological",
    "hydrological": "hydrological",
    "Climatological (other)": "climatological_other",
    "climatological (heatwaves)": "climatological_heatwaves",
}
HAZARDS = tuple(HAZARD_COLUMNS.values())


def read_wide_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A wide loss table stored as parquet, or as CSV with a header and a schema."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r}; use 'parquet' or 'csv'")
    if schema is None:
        raise ValueError("a CSV loss table needs a schema; inferring it would read the data twice")
    return spark.read.option("header", True).schema(schema).csv(path)


def read_losses(
    spark: SparkSession,
    by_hazard: str,
    by_year: str,
    fmt: str = "parquet",
    hazard_schema: str | None = None,
    year_schema: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(cumulative losses by hazard, annual losses by year)."""
    return (
        read_wide_table(spark, by_hazard, fmt, hazard_schema),
        read_wide_table(spark, by_year, fmt, year_schema),
    )
