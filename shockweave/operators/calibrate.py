"""Losses and output -> hazard intensities -> percentile table -> shock sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockweave.functions.numeric import nan_to_null, ratio, zero_if_null
from shockweave.sources.losses import HAZARD_COLUMNS
from shockweave.storage import cut

# Intensity levels in rising order with their quantiles.
INTENSITY_LEVELS = {"moderate": 0.50, "severe": 0.75, "extreme": 0.90, "very_extreme": 0.95}
CURRENT_PRICES, CHAIN_LINKED = "CP_MEUR", "CLV20_MEUR"


def constant_price_output(
    cells: DataFrame,
    base_year: int = 2024,
    geos: Sequence[str] | DataFrame | None = None,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Output at base-year prices per (geo, year) from ``(geo, unit, year, value)`` cells.

    Volumes are scaled by the country's own base-year price level. Where that
    is missing, current prices are moved by the pooled deflator of all
    countries with both series, and the row is flagged. Rows that neither rule
    fills are dropped. Without a base-year row the job fails.
    """
    wanted = cells.filter(F.col("unit").isin(CURRENT_PRICES, CHAIN_LINKED))
    if isinstance(geos, DataFrame):
        wanted = wanted.join(geos.select("geo").distinct(), "geo", "left_semi")
    elif geos is not None:
        wanted = wanted.filter(F.col("geo").isin(*geos))
    if years is not None:
        wanted = wanted.filter(F.col("year").isin(*[int(y) for y in years]))
    # Keys are unique per unit, so a grouped maximum is the pivot cell; groups
    # whose cells are all missing disappear, as they would from a pivot.
    # Written, as price levels, deflators and rows all read it: cells are scanned once.
    series = cut(
        wanted.filter(nan_to_null("value").isNotNull())
        .groupBy("geo", "year")
        .agg(
            F.max(F.when(F.col("unit") == CURRENT_PRICES, F.col("value"))).alias("cp"),
            F.max(F.when(F.col("unit") == CHAIN_LINKED, F.col("value"))).alias("clv"),
        )
    )
    at_base = series.filter(F.col("year") == base_year)
    base_rows = at_base.agg(F.count("*")).scalar()
    level = at_base.select("geo", F.try_divide("cp", "clv").alias("price_level"))
    pooled = (
        series.filter(F.col("cp").isNotNull() & F.col("clv").isNotNull())
        .groupBy("year")
        .agg(F.try_divide(F.sum("cp"), F.sum("clv")).alias("d_pool"))
    )
    d_base = pooled.filter(F.col("year") == base_year).agg(F.max("d_pool")).scalar()

    own = F.col("clv") * F.col("price_level")
    moved = F.col("cp") * F.try_divide(F.col("d_base"), F.col("d_pool"))
    return (
        series.join(level, "geo", "left")
        .join(pooled, "year", "left")
        .withColumn("d_base", d_base)
        .withColumn(
            "base_rows",
            F.when(base_rows > 0, base_rows).otherwise(
                F.raise_error(F.lit(f"no rows for base year {base_year}"))
            ),
        )
        .filter(F.col("base_rows") > 0)
        .select(
            "geo",
            "year",
            F.col("cp").alias("cp_mn_eur"),
            F.col("clv").alias("clv20_mn_eur"),
            "price_level",
            F.coalesce(own, moved).alias("output_mn_eur"),
            F.when(F.col("d_base").isNotNull(), F.col("d_pool")).alias("d_pool"),
            (own.isNull() & F.col("d_base").isNotNull()).alias("used_pooled_deflator"),
        )
        .filter(F.col("output_mn_eur").isNotNull())
    )


def fallback_report(output: DataFrame) -> DataFrame:
    """One row: how many rows used the pooled deflator, and for which countries."""
    used = F.col("used_pooled_deflator")
    return output.agg(
        F.count_if(used).alias("rows_on_fallback"),
        F.array_sort(F.collect_set(F.when(used, F.col("geo")))).alias("geos_on_fallback"),
    )


def hazard_shares(losses: DataFrame, country: str = "ISO2") -> DataFrame:
    """``(ISO2, hazard, omega)``: a hazard's part of the country's cumulative losses.

    The row total is taken before unpivoting, so nothing is shuffled.
    """
    titles = [c for c in losses.columns if c in HAZARD_COLUMNS or c in HAZARD_COLUMNS.values()]
    if not titles:
        raise ValueError(f"no hazard columns among {losses.columns}")
    names = [HAZARD_COLUMNS.get(c, c) for c in titles]
    wide = losses.select(F.col(country).alias("ISO2"), *[nan_to_null(F.col(f"`{c}`")).alias(n) for c, n in zip(titles, names)])
    total = sum((zero_if_null(n) for n in names), F.lit(0.0))
    return (
        wide.withColumn("_total", total)
        .select("ISO2", *[ratio(n, "_total").alias(n) for n in names])
        .unpivot("ISO2", names, "hazard", "omega")
    )


def annual_losses(losses: DataFrame, country: str = "ISO2") -> DataFrame:
    """``(ISO2, year, loss_total)`` from year columns such as ``1995`` or ``y1995``."""
    years = {c: c.lstrip("yY") for c in losses.columns}
    years = {c: y for c, y in years.items() if y.isdigit()}
    if not years:
        raise ValueError(f"no year columns among {losses.columns}")
    wide = losses.select(F.col(country).alias("ISO2"), *[nan_to_null(F.col(f"`{c}`")).alias(y) for c, y in years.items()])
    return wide.unpivot("ISO2", list(years.values()), "year", "loss_total").withColumn(
        "year", F.col("year").cast("int")
    )


def intensity_panel(
    by_hazard: DataFrame,
    by_year: DataFrame,
    output: DataFrame,
    geo: str = "geo",
    years: Sequence[int] | None = None,
) -> DataFrame:
    """``(ISO2, year, hazard, loss_hazard, output_mn_eur, intensity)``."""
    out = output.select(F.col(geo).alias("ISO2"), "year", "output_mn_eur")
    annual = annual_losses(by_year)
    if years is not None:
        annual = annual.filter(F.col("year").isin(*[int(y) for y in years]))
    return (
        annual.join(hazard_shares(by_hazard), "ISO2", "left")
        .withColumn("loss_hazard", F.col("loss_total") * F.col("omega"))
        .join(out, ["ISO2", "year"])
        .select(
            "ISO2",
            "year",
            "hazard",
            "loss_hazard",
            "output_mn_eur",
            ratio("loss_hazard", "output_mn_eur").alias("intensity"),
        )
    )


def percentile_table(
    panel: DataFrame, levels: Mapping[str, float] = INTENSITY_LEVELS, min_years: int = 10
) -> DataFrame:
    """``(ISO2, hazard, <level>...)`` for groups with at least ``min_years`` values.

    A group holds one value per year, so the exact interpolated percentile fits
    a task whatever the number of groups. Count and quantiles share one pass.
    """
    known = panel.filter(F.col("ISO2").isNotNull() & F.col("hazard").isNotNull())
    quantiles = F.percentile("intensity", [float(q) for q in levels.values()])
    return (
        known.groupBy("ISO2", "hazard")
        .agg(F.count("intensity").alias("_n"), quantiles.alias("_q"))
        .filter(F.col("_n") >= min_years)
        .select("ISO2", "hazard", *[F.col("_q")[k].alias(name) for k, name in enumerate(levels)])
    )


def level_scalars(table: DataFrame, levels: Sequence[str] = tuple(INTENSITY_LEVELS)) -> DataFrame:
    """Percentile table as ``(ISO2, hazard, level, value)``; a level without a column is NULL."""
    columns = [F.col(n) if n in table.columns else F.lit(None).cast("double").alias(n) for n in levels]
    return table.select("ISO2", "hazard", *columns).unpivot(["ISO2", "hazard"], list(levels), "level", "value")


def shock_scalars(
    requests: DataFrame,
    table: DataFrame,
    clamp_max: float = 0.5,
    levels: Sequence[str] = tuple(INTENSITY_LEVELS),
) -> DataFrame:
    """Adds ``scalar`` to every (ISO2, hazard, level) request: 0 if unknown or negative, capped."""
    value = F.when(F.isnan("value") | (F.col("value") < 0), F.lit(0.0)).otherwise(zero_if_null("value"))
    return requests.join(level_scalars(table, levels), ["ISO2", "hazard", "level"], "left").select(
        *requests.columns, F.least(value, F.lit(float(clamp_max))).alias("scalar")
    )


def hazard_catalog(table: DataFrame) -> DataFrame:
    """Distinct non-blank hazards in order."""
    return (
        table.filter(F.col("hazard").isNotNull() & (F.length(F.trim("hazard")) > 0))
        .select("hazard")
        .distinct()
        .orderBy("hazard")
    )


def ordered_levels(available: DataFrame) -> DataFrame:
    """Distinct known levels of column ``level`` from weakest to strongest."""
    order = F.array_position(F.array(*[F.lit(n) for n in INTENSITY_LEVELS]), F.col("level"))
    return (
        available.select("level", order.cast("int").alias("level_order"))
        .filter(F.col("level_order") > 0)
        .distinct()
        .orderBy("level_order")
    )


def catalog(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column in order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
