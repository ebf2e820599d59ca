"""Code dimensions: sector names and country names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockweave.functions.labels import ISO_COUNTRIES, canonical_country, is_filled, prefixed_code


def read_dimension(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


#: Columns of code and name, the more detailed classification first.
CODE_LEVELS = (("estat_s63g_code", "estat_s63g_des"), ("estat_s11g_code", "estat_s11g_des"))


def sector_decoder(
    dim: DataFrame, wanted: DataFrame | None = None, levels: Sequence[tuple[str, str]] = CODE_LEVELS
) -> DataFrame:
    """``(sector, sector_name)``: of the first level that has the code, the smallest name.

    The dimension is read once: every row offers a name per level, and the least (level,
    name) of a sector wins, so reruns agree. ``wanted`` limits the result to the sectors of
    a run (column ``sector``).
    """
    offers = F.array(
        *[
            F.when(is_filled(code), F.struct(prefixed_code(code).alias("sector"), F.lit(k).alias("level"), F.trim(F.col(name)).alias("name")))
            for k, (code, name) in enumerate(levels)
        ]
    )
    offered = dim.select(F.explode(offers).alias("o")).filter(F.col("o").isNotNull()).select("o.*")
    if wanted is not None:
        offered = offered.join(wanted.select("sector").distinct(), "sector", "left_semi")
    best = F.min(F.struct("level", F.col("name").isNull().alias("unnamed"), "name"))
    return offered.groupBy("sector").agg(best.alias("best")).select("sector", F.col("best.name").alias("sector_name"))


def iso_dimension(spark: SparkSession) -> DataFrame:
    """The fixed ISO table as ``(code, iso3, name)``."""
    rows = [(code, iso3, name) for code, (iso3, name) in ISO_COUNTRIES.items()]
    return spark.createDataFrame(rows, "code string, iso3 string, name string")


def decode_countries(df: DataFrame, dim: DataFrame, country: str = "country") -> DataFrame:
    """Adds ``iso3`` and ``country_name``; an unknown code stands for itself."""
    key = canonical_country(country)
    names = dim.select(
        canonical_country("code").alias("_code"),
        F.col("iso3").alias("_iso3"),
        F.col("name").alias("_name"),
    )
    return (
        df.withColumn("_key", key)
        .join(names, F.col("_key") == F.col("_code"), "left")
        .withColumn("iso3", F.coalesce("_iso3", "_key"))
        .withColumn("country_name", F.coalesce("_name", "_key"))
        .drop("_key", "_code", "_iso3", "_name")
    )


def decode_sectors(df: DataFrame, decoder: DataFrame) -> DataFrame:
    """Adds ``sector_name``, falling back to the sector code."""
    names = decoder.select("sector", F.col("sector_name").alias("_name"))
    return (
        df.join(names, "sector", "left")
        .withColumn("sector_name", F.coalesce("_name", "sector"))
        .drop("_name")
    )
