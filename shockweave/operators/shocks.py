"""Scenario tables -> shock vectors keyed by (scenario_id, node)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockweave.functions.numeric import zero_if_null
from shockweave.operators.calibrate import INTENSITY_LEVELS

# Fixed schema of a scenario table. NULL lists take the shared filter, empty
# lists match everything; sizes are percent.
SCENARIO_SCHEMA = (
    "scenario_id string, countries array<string>, sectors array<string>, "
    "supply_countries array<string>, supply_sectors array<string>, "
    "demand_countries array<string>, demand_sectors array<string>, "
    "supply_pct double, demand_pct double"
)


def _checked_pct(name: str) -> Column:
    pct = zero_if_null(name)
    ok = ~F.isnan(pct) & (pct >= 0) & (pct <= 100)
    message = F.concat(F.lit(f"{name} must be in [0, 100], got "), pct.cast("string"))
    return F.when(ok, pct).otherwise(F.raise_error(message))


def per_node(scenarios: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every scenario on every node, which is the size of a run's state.

    Scenarios are expanded over the catalog of countries and then meet the
    nodes in an equi-join, which Spark can hash, broadcast or split by skew.
    """
    catalog = nodes.agg(F.collect_set("country")).scalar()
    return scenarios.withColumn("country", F.explode(catalog)).join(nodes, "country")


def targeted_shocks(scenarios: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(scenario_id, node, label, sd, sp)`` of the nodes that country and sector targets hit.

    Targets become rows of (country, sector), an empty list standing for all there are, and
    meet the nodes in one equi-join, so rows grow with hits; a node without a row is not hit.
    """
    none = F.array().cast("array<string>")
    all_of = {c: nodes.agg(F.collect_set(c)).scalar() for c in ("country", "sector")}
    checked = scenarios.withColumn("supply_pct", _checked_pct("supply_pct")).withColumn(
        "demand_pct", _checked_pct("demand_pct")
    )

    def targets(kind: str) -> DataFrame:
        def codes(plural: str, code: str) -> Column:
            given = F.coalesce(f"{kind}_{plural}", plural, none)
            return F.when(F.size(given) == 0, all_of[code]).otherwise(F.array_distinct(given))

        pct = F.col(f"{kind}_pct")
        rows = checked.filter(pct > 0).select("scenario_id", (pct / 100.0).alias("shock"), codes("countries", "country").alias("c"), codes("sectors", "sector").alias("s"))
        rows = rows.select("scenario_id", "shock", F.explode("c").alias("country"), "s")
        return rows.select("scenario_id", "shock", "country", F.explode("s").alias("sector"), F.lit(kind).alias("kind"))

    def of_kind(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("shock")).otherwise(F.lit(0.0)))

    return (
        targets("supply")
        .unionByName(targets("demand"))
        .join(nodes.select("node", "label", "country", "sector"), ["country", "sector"])
        .groupBy("scenario_id", "node", "label")
        .agg(of_kind("demand").alias("sd"), of_kind("supply").alias("sp"))
    )


def flat_shocks(scalars: DataFrame, nodes: DataFrame) -> DataFrame:
    """Supply shock ``scalar`` on all nodes of the scenario's country; other nodes have no row.

    ``scalars`` holds (scenario_id, ISO2, scalar).
    """
    sized = scalars.filter(F.col("scalar") > 0).select("scenario_id", F.col("ISO2").alias("country"), "scalar")
    return sized.join(nodes.select("node", "label", "country"), "country").select(
        "scenario_id", "node", "label", F.lit(0.0).alias("sd"), F.col("scalar").alias("sp")
    )


def whole_vectors(hits: DataFrame, scenarios: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(scenario_id, node, label, sd, sp)`` of every scenario on every node, 0 where ``hits`` has no row."""
    every = scenarios.select("scenario_id").distinct().crossJoin(nodes.select("node", "label"))
    return every.join(hits.select("scenario_id", "node", "sd", "sp"), ["scenario_id", "node"], "left").select(
        "scenario_id", "node", "label", zero_if_null("sd").alias("sd"), zero_if_null("sp").alias("sp")
    )


def scenario_grid(
    countries: DataFrame, hazards: Sequence[str], levels: Sequence[str] = tuple(INTENSITY_LEVELS)
) -> DataFrame:
    """``(scenario_id, ISO2, hazard, level)``: each country under each hazard and level."""
    return (
        countries.select(F.col("country").alias("ISO2"))
        .distinct()
        .withColumn("hazard", F.explode(F.array(*[F.lit(h) for h in hazards])))
        .withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels])))
        .select(F.concat_ws("|", "ISO2", "hazard", "level").alias("scenario_id"), "ISO2", "hazard", "level")
    )
