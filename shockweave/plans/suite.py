"""All result tables of a stress run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shockweave.operators import impact, linkage
from shockweave.plans.stress import StressResult
from shockweave.sources.dims import decode_countries, decode_sectors
from shockweave.storage import cut


def impact_tables(result: StressResult, **options) -> dict[str, DataFrame]:
    """``tables_of`` a run."""
    return tables_of(result.nodes, result.network.nodes, result.edges(), **options)


def tables_of(
    state: DataFrame,
    network_nodes: DataFrame,
    flows: DataFrame,
    sector_names: DataFrame | None = None,
    country_dim: DataFrame | None = None,
    value_added: DataFrame | None = None,
    employment: DataFrame | None = None,
    employment_per_output: DataFrame | None = None,
    metric: str = "A",
    top_k: int = 25,
    min_abs_delta: float = linkage.MIN_ABS_DELTA,
) -> dict[str, DataFrame]:
    """``nodes, country, sector, links_weakened, links_strengthened, links_all, totals``.

    From final ``state`` (scenario_id, node), the network's nodes and baseline and final
    ``flows`` (scenario_id, i, j). Link changes are written once, because both rankings and
    the sparse table read them.
    """
    nodes = impact.node_impacts(state, network_nodes, value_added, employment, employment_per_output)
    if sector_names is not None:
        nodes = decode_sectors(nodes, sector_names)
    if country_dim is not None:
        nodes = decode_countries(nodes, country_dim).drop("iso3")
    changes = cut(linkage.link_changes(flows, state, network_nodes, metric, min_abs_delta))
    return {
        "nodes": impact.by_loss(nodes),
        "country": impact.by_loss(impact.country_impacts(nodes)),
        "sector": impact.by_loss(impact.sector_impacts(nodes)),
        "links_weakened": linkage.top_links(changes, "weakened", top_k),
        "links_strengthened": linkage.top_links(changes, "strengthened", top_k),
        "links_all": linkage.changed_links(changes),
        "totals": impact.totals(nodes, state),
    }
