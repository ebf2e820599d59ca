"""Impact tables by node, country and sector, and scenario totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockweave.functions.numeric import floor_zero, percent, ratio, zero_if_null

MEASURES = ("X", "VA", "EMP")


def _loss_columns(m: str) -> tuple[str, str]:
    return ("loss_abs", "loss_pct") if m == "X" else (f"{m}_loss_abs", f"{m}_loss_pct")


def _with_losses(df: DataFrame, m: str) -> DataFrame:
    lost, pct = _loss_columns(m)
    return df.withColumn(lost, F.col(f"{m}_baseline") - F.col(f"{m}_final")).withColumn(
        pct, percent(lost, f"{m}_baseline")
    )


def node_impacts(
    final: DataFrame,
    nodes: DataFrame,
    value_added: DataFrame | None = None,
    employment: DataFrame | None = None,
    employment_per_output: DataFrame | None = None,
) -> DataFrame:
    """Output, value added and employment before and after, per scenario and node.

    ``final`` holds (scenario_id, node, xs, z_col). Value added is output less
    inputs unless ``value_added`` (node, va0) is given; only its final value is
    floored at 0. Employment comes as (node, emp0), or as (node,
    emp_per_output) times baseline output, and moves with output.
    """
    base = nodes.select("node", "label", "country", "sector", F.col("x").alias("X_baseline"), (F.col("x") - F.col("z_col")).alias("va0"))
    if value_added is not None:
        base = base.drop("va0").join(value_added.select("node", "va0"), "node", "left")
    if employment is not None:
        base = base.join(employment.select("node", "emp0"), "node", "left")
    elif employment_per_output is not None:
        base = base.join(employment_per_output.select("node", "emp_per_output"), "node", "left").withColumn(
            "emp0", zero_if_null("emp_per_output") * F.col("X_baseline")
        )
    after = final.select("scenario_id", "node", F.col("xs").alias("X_final"), F.col("z_col").alias("_inputs"))
    joined = (
        after.join(base, "node")
        .withColumn("VA_baseline", F.col("va0"))
        .withColumn("VA_final", floor_zero(F.col("X_final") - F.col("_inputs")))
    )
    measures = ["X", "VA"]
    if "emp0" in joined.columns:
        joined = joined.withColumn("EMP_baseline", F.col("emp0")).withColumn(
            "EMP_final", F.col("emp0") * ratio("X_final", "X_baseline")
        )
        measures.append("EMP")
    for m in measures:
        joined = _with_losses(joined, m)
    columns = [c for m in measures for c in (f"{m}_baseline", f"{m}_final", *_loss_columns(m))]
    return joined.select("scenario_id", "node", "label", "country", "sector", *columns)


def _measures(df: DataFrame) -> list[str]:
    return [m for m in MEASURES if f"{m}_baseline" in df.columns]


def rollup(impacts: DataFrame, by: Sequence[str], keys: Sequence[str] = ("scenario_id",)) -> DataFrame:
    """Sums per group with percentages taken from the sums, all in one aggregation."""
    sums, measures = [], _measures(impacts)
    for m in measures:
        for c in (f"{m}_baseline", f"{m}_final", _loss_columns(m)[0]):
            sums.append(zero_if_null(F.sum(c)).alias(c))
    grouped = impacts.groupBy(*keys, *by).agg(*sums)
    for m in measures:
        lost, pct = _loss_columns(m)
        grouped = grouped.withColumn(pct, percent(lost, f"{m}_baseline"))
    return grouped


def country_impacts(impacts: DataFrame) -> DataFrame:
    return rollup(impacts, ["country"])


def sector_impacts(impacts: DataFrame) -> DataFrame:
    by = ["sector", "sector_name"] if "sector_name" in impacts.columns else ["sector"]
    return rollup(impacts, by)


def totals(impacts: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """Per scenario: baseline, final, loss and loss percent of each measure, and final demand.

    The percent divides by the total plus 1e-12, so an empty economy gives 0.
    """
    measures = _measures(impacts)
    sums = [
        zero_if_null(F.sum(f"{m}_{when}")).alias(f"{m}_{when}_total")
        for m in measures
        for when in ("baseline", "final")
    ]
    result = impacts.groupBy("scenario_id").agg(*sums)
    for m in measures:
        before, after = F.col(f"{m}_baseline_total"), F.col(f"{m}_final_total")
        result = result.withColumn(f"{m}_loss_abs_total", before - after).withColumn(
            f"{m}_loss_pct_total", F.lit(100.0) * (before - after) / (before + 1e-12)
        )
    if final is not None:
        demand = final.groupBy("scenario_id").agg(F.sum("fd_next").alias("FD_post_total"))
        result = result.join(demand, "scenario_id", "left")
    return result


def by_loss(df: DataFrame) -> DataFrame:
    """Largest loss first within each scenario."""
    rest = [c for c in ("node", "country", "sector") if c in df.columns]
    return df.orderBy("scenario_id", F.desc("loss_abs"), *rest)
