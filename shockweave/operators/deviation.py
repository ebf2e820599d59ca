"""Deviation from the scenario mean, ranked tables, map table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockweave.functions.labels import resolve
from shockweave.functions.numeric import lenient_double
from shockweave.sources.dims import decode_countries


def mean_deviation(
    df: DataFrame,
    metric: str = "loss_pct",
    output: str = "loss_pct_deviation",
    keys: Sequence[str] = ("scenario_id",),
) -> DataFrame:
    """Adds ``metric`` less its mean over the scenario; missing values stay missing.

    The mean is a partial aggregation joined back, not a window, so a scenario
    is never held in one task.
    """
    if metric not in df.columns:
        raise ValueError(f"no column {metric!r} to take deviations of; there are {', '.join(df.columns)}")
    v = lenient_double(metric)
    if not keys:
        return df.withColumn(output, v - df.agg(F.avg(v)).scalar())
    mean = df.groupBy(*keys).agg(F.avg(v).alias("_mean"))
    return df.join(mean, list(keys)).withColumn(output, v - F.col("_mean")).drop("_mean")


def sector_deviations(
    sectors: DataFrame,
    metric: str = "loss_pct",
    output: str = "loss_pct_deviation",
    mode: str = "top_bottom",
    k: int = 20,
    keys: Sequence[str] = ("scenario_id",),
) -> DataFrame:
    """Sectors by deviation: the whole distribution, or the ``k`` largest of each sign."""
    if mode not in ("top_bottom", "full_distribution"):
        raise ValueError(f"mode must be 'top_bottom' or 'full_distribution', not {mode!r}")
    d = mean_deviation(sectors, metric, output, keys)
    label = resolve(d, ("sector_name", "sector"), "sector label")
    direction = F.when(F.col(output) >= 0, "Positive").otherwise("Negative")
    d = d.withColumn("sector_label", F.col(label).cast("string")).withColumn("direction", direction)
    if mode == "full_distribution":
        return d.orderBy(*keys, F.asc_nulls_last(output), "sector_label")

    def extreme(sign: str) -> DataFrame:
        chosen = d.filter(F.col(output) > 0 if sign == "+" else F.col(output) < 0)
        first = F.desc(output) if sign == "+" else F.asc(output)
        group = list(keys) or [F.lit(0)]
        rank = F.row_number().over(W.partitionBy(*group).orderBy(first, "sector_label"))
        return chosen.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")

    return extreme("-").unionByName(extreme("+")).orderBy(*keys, output, "sector_label")


def symmetric_range(df: DataFrame, column: str, keys: Sequence[str] = ("scenario_id",)) -> DataFrame:
    """``(keys, range_min, range_max)``: plus and minus the largest magnitude, at least 1e-9.

    A scenario whose values are all missing gets plus and minus 1.
    """
    largest = F.max(F.abs(lenient_double(column)))
    high = F.when(largest.isNull(), F.lit(1.0)).otherwise(F.greatest(largest, F.lit(1e-9)))
    return df.groupBy(*keys).agg(high.alias("range_max")).withColumn("range_min", -F.col("range_max"))


def map_table(countries: DataFrame, dim: DataFrame, metric: str = "loss_pct") -> DataFrame:
    """Per country: codes, name, metric, deviation, losses and the scenario's symmetric range."""
    output = f"{metric}_deviation"
    d = mean_deviation(countries, metric, output)
    ranged = d.join(symmetric_range(d, output), "scenario_id")
    return decode_countries(ranged, dim).select(
        "scenario_id", "country", "iso3", "country_name", "loss_pct", "loss_abs", output, "range_min", "range_max"
    )


def top_by(df: DataFrame, metric: str, name: str, k: int = 20, keys: Sequence[str] = ("scenario_id",)) -> DataFrame:
    """The ``k`` rows with the largest metric per scenario; ties go by ``name``."""
    if metric not in df.columns:
        raise ValueError(f"nothing to rank by: {metric!r} is not among {', '.join(df.columns)}")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(metric), name))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def select_countries(decoded: DataFrame, iso3: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the selected ISO-3 codes; an empty selection keeps all."""
    if isinstance(iso3, DataFrame):
        return decoded.join(iso3.select("iso3").distinct(), "iso3", "left_semi")
    return decoded.filter(F.col("iso3").isin(*iso3)) if iso3 else decoded
