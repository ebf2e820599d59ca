"""Registered queries: each takes (spark, sf_dir) and reads the driver tables.

Amounts are rounded for display, as decimals: sums of prices lie on a decimal grid, where
halves must be round numbers whatever the order of summation. Result tables of a settled
state read one run, which is computed once for given input files and parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shockweave.functions.labels import node_label
from shockweave.functions.numeric import as_col
from shockweave.operators import (
    calibrate,
    checks,
    deviation,
    heatmap,
    impact,
    linkage,
    network,
    propagate,
    required,
    shocks,
)
from shockweave.plans import fixtures as fx
from shockweave.plans import stress, suite
from shockweave.sources import bundle, cube, dims, flows, sinks
from shockweave.sources.losses import HAZARD_COLUMNS, HAZARDS, read_losses
from shockweave.storage import cut, fresh_path

GAMMA = 0.5
K2 = {"gamma": GAMMA, "max_iter": 2, "tol": 1e-9, "inner_rounds": 8}
SETTLED = {"gamma": 0.05, "max_iter": 200, "tol": 1e-4, "inner_tol": 1e-13}
#: Smallest change of a link that counts in a settled state, by metric.
MOVED = {"A": 1e-9, "Z": 1e-3}
FLOW_INPUTS = ("lineitem", "orders", "part", "supplier", "customer", "nation")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def plain(c: str | Column, digits: int = 4) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round(as_col(c), digits) + F.lit(0.0)
    return out.alias(name) if name else out


def money(c: str, digits: int = 2) -> Column:
    return F.round(F.col(c).cast("decimal(32,5)"), digits).cast("double").alias(c)


def rate(c: str, digits: int = 8) -> Column:
    return plain(c, digits)


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.latest_period(fx.flow_table(spark, sf_dir), at_most=fx.newest_year(spark, sf_dir))


def _network(spark: SparkSession, sf_dir: str) -> network.Network:
    return network.build_network(_newest(spark, sf_dir))


def _named(df: DataFrame, net: network.Network, *ends: str) -> DataFrame:
    """Replaces node numbers by labels: ``i`` -> ``i_label``, ``node`` -> ``label``."""
    labels = net.nodes.select("node", "label")
    for end in ends:
        name = "label" if end == "node" else f"{end}_label"
        df = df.drop(name).join(labels.withColumnsRenamed({"node": end, "label": name}), end)
    return df


# --- network inputs ---------------------------------------------------------


@query
def latest_period_flows(spark, sf_dir):
    return _newest(spark, sf_dir).select("time_period", "c_orig", "ind_ava", "c_dest", "ind_use", plain("value"))


@query
def compact_flow_pairs(spark, sf_dir):
    pairs = flows.compact_flows(fx.flow_table(spark, sf_dir))
    return pairs.select("c_orig", "ind_ava", "c_dest", "ind_use", plain("value"))


@query
def node_table(spark, sf_dir):
    return network.node_table(_newest(spark, sf_dir))


@query
def edge_table(spark, sf_dir):
    compact = cut(flows.compact_flows(_newest(spark, sf_dir)))
    nodes = network.node_table(compact)
    return network.edge_table(compact, nodes).select("i", "j", "globsec", plain("z"))


@query
def final_demand_output(spark, sf_dir):
    nodes = _network(spark, sf_dir).nodes
    return nodes.select("label", plain("fd"), plain("z_row"), plain("z_col"), plain("x"))


@query
def detailed_network_output(spark, sf_dir):
    """Accounts of the larger network, whose sectors are type x brand."""
    newest = flows.latest_period(fx.detailed_flow_table(spark, sf_dir), at_most=fx.newest_year(spark, sf_dir))
    nodes = network.build_network(newest).nodes
    return nodes.select("node", "label", "globsec", plain("fd"), plain("z_row"), plain("z_col"), plain("x"))


@query
def network_sanity(spark, sf_dir):
    net = _network(spark, sf_dir)
    report = checks.network_sanity(net.nodes, net.edges)
    return report.select(
        F.col("n_nodes").cast("int"),
        F.col("n_edges").cast("int"),
        *[plain(c) for c in ("min_z", "min_a", "min_fd", "min_x")],
        *[money(c) for c in ("total_z", "total_fd", "total_x")],
        plain("accounting_gap", 2),
    )


@query
def coefficients(spark, sf_dir):
    net = _network(spark, sf_dir)
    return _named(net.edges, net, "i", "j").select("i_label", "j_label", rate("a"))


def _flows_with_shares(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Flows with shares, those between two given countries off by one percent, and the nodes."""
    source = cut(_newest(spark, sf_dir))
    nodes = cut(network.numbered(cut(network.account_sums(flows.compact_flows(source)))))
    off = (F.col("c_orig") == "NATION_1") & (F.col("c_dest") == "NATION_2")
    shared = fx.with_shares(source, nodes).withColumn(
        "share", F.when(off, F.col("share") * 1.01).otherwise(F.col("share"))
    )
    return shared, nodes


@query
def coefficients_share(spark, sf_dir):
    shared, _ = _flows_with_shares(spark, sf_dir)
    net = network.build_network(shared, coefficients="share")
    return _named(net.edges, net, "i", "j").select("i_label", "j_label", rate("a"), rate("t"))


@query
def coefficient_check(spark, sf_dir):
    shared, nodes = _flows_with_shares(spark, sf_dir)
    edges = network.edge_table(flows.compact_flows(shared), nodes)
    gaps = checks.coefficient_gaps(edges, nodes)
    return gaps.select("i", "j", rate("share"), rate("derived"), rate("gap"))


@query
def global_technology(spark, sf_dir):
    net = _network(spark, sf_dir)
    return network.global_technology(net.edges).select("globsec", "j", rate("ag"))


# --- code dimensions --------------------------------------------------------


def _catalogued(df: DataFrame, name: str) -> str:
    """A catalog table of ``df`` with its files in the shared folder; its name."""
    path = fresh_path(df.sparkSession, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.option("path", path).saveAsTable(table)
    return table


@query
def flows_from_catalog(spark, sf_dir):
    """The newest period of a flow table in the catalog, summed to account pairs."""
    table = _catalogued(fx.flow_table(spark, sf_dir), "flows")
    pairs = flows.compact_flows(flows.load_latest_flows(spark, table))
    return pairs.select("c_orig", "ind_ava", "c_dest", "ind_use", plain("value"))


@query
def decoder_from_catalog(spark, sf_dir):
    """Sector names from a code dimension in the catalog."""
    return dims.sector_decoder(dims.read_dimension(spark, _catalogued(fx.code_dimension(spark, sf_dir), "codes")))


@query
def sector_decoder(spark, sf_dir):
    nodes = network.account_nodes(_newest(spark, sf_dir))
    return dims.sector_decoder(fx.code_dimension(spark, sf_dir), wanted=nodes)


@query
def node_names(spark, sf_dir):
    nodes = network.account_nodes(_newest(spark, sf_dir))
    named = dims.decode_sectors(nodes, dims.sector_decoder(fx.code_dimension(spark, sf_dir)))
    decoded = dims.decode_countries(named, fx.country_dimension(spark, sf_dir))
    return decoded.select(node_label("country", "sector").alias("label"), "sector_name", "iso3", "country_name")


@query
def country_decode(spark, sf_dir):
    nations = fx.table(spark, sf_dir, "nation").select(
        F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("country")
    )
    return dims.decode_countries(nations, fx.country_dimension(spark, sf_dir))


@query
def country_selection(spark, sf_dir):
    decoded = country_decode(spark, sf_dir)
    return deviation.select_countries(decoded, ["C1", "C4", "C19", "NATION_22"])


# --- cube payloads ----------------------------------------------------------


def _decoded(long: DataFrame) -> DataFrame:
    return cube.output_cells(long).select("geo", "unit", "year", plain("value"))


@query
def cube_jsonstat_long(spark, sf_dir):
    return _decoded(cube.jsonstat_to_long(fx.jsonstat_payloads(fx.output_cells(spark, sf_dir))))


@query
def cube_sdmx_long(spark, sf_dir):
    return _decoded(cube.sdmx_to_long(fx.sdmx_payloads(fx.output_cells(spark, sf_dir))))


@query
def cube_dispatch(spark, sf_dir):
    return _decoded(cube.payloads_to_long(cut(fx.mixed_payloads(spark, sf_dir))))


@query
def cube_quarantine(spark, sf_dir):
    return cube.quarantined(fx.mixed_payloads(spark, sf_dir))


# --- output and calibration -------------------------------------------------


def _output(spark, sf_dir, facts: DataFrame | None = None) -> DataFrame:
    return calibrate.constant_price_output(fx.output_cells(spark, sf_dir, facts), base_year=fx.BASE_YEAR)


@query
def constant_price_output(spark, sf_dir):
    return _output(spark, sf_dir).select(
        "geo", "year", plain("cp_mn_eur"), plain("clv20_mn_eur"), rate("price_level"),
        money("output_mn_eur"), rate("d_pool"), "used_pooled_deflator",
    )


@query
def constant_price_output_from_cubes(spark, sf_dir):
    cells = cube.output_cells(cube.payloads_to_long(cut(fx.mixed_payloads(spark, sf_dir))))
    output = calibrate.constant_price_output(
        cells, base_year=fx.BASE_YEAR, geos=fx.country_dimension(spark, sf_dir).select(F.col("code").alias("geo")), years=fx.YEARS
    )
    return output.select("geo", "year", money("output_mn_eur"), "used_pooled_deflator")


@query
def fallback_report(spark, sf_dir):
    report = calibrate.fallback_report(_output(spark, sf_dir))
    return report.select(
        F.col("rows_on_fallback").cast("int"), F.array_join("geos_on_fallback", ",").alias("geos_on_fallback")
    )


@query
def output_series_export(spark, sf_dir):
    path = fresh_path(spark, "output-series")
    written = _output(spark, sf_dir).select("geo", "year", "output_mn_eur")
    sinks.export_output_series(written, path, "csv")
    back = spark.read.option("header", True).schema("geo string, year int, output_mn_eur double").csv(path)
    return back.select("geo", "year", money("output_mn_eur"))


@query
def hazard_shares(spark, sf_dir):
    return calibrate.hazard_shares(fx.losses_by_hazard(spark, sf_dir)).select("ISO2", "hazard", rate("omega"))


@query
def annual_losses(spark, sf_dir):
    return calibrate.annual_losses(fx.losses_by_year(spark, sf_dir)).select("ISO2", "year", plain("loss_total"))


def _panel(spark, sf_dir, years: list[int] | None = None) -> DataFrame:
    """Losses and output from one scan of the order lines."""
    facts = fx.trade_facts(spark, sf_dir)
    by_hazard, by_year = fx.losses_by_hazard(spark, sf_dir, facts), fx.losses_by_year(spark, sf_dir, facts)
    return calibrate.intensity_panel(by_hazard, by_year, _output(spark, sf_dir, facts), years=years)


@query
def intensity_panel(spark, sf_dir):
    return _panel(spark, sf_dir).select(
        "ISO2", "year", "hazard", money("loss_hazard"), money("output_mn_eur"), rate("intensity", 10)
    )


@query
def intensity_panel_years(spark, sf_dir):
    return _panel(spark, sf_dir, [1996, 1999]).select("ISO2", "year", "hazard", rate("intensity", 10))


def _percentiles(spark, sf_dir) -> DataFrame:
    return calibrate.percentile_table(_panel(spark, sf_dir), min_years=fx.MIN_YEARS)


@query
def percentile_table(spark, sf_dir):
    return _percentiles(spark, sf_dir).select(
        "ISO2", "hazard", *[rate(level, 10) for level in calibrate.INTENSITY_LEVELS]
    )


@query
def percentiles_kept(spark, sf_dir):
    """The percentile table computed once for given input files and read from then on."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in FLOW_INPUTS]
    parameters = {"levels": calibrate.INTENSITY_LEVELS, "min_years": fx.MIN_YEARS, "base_year": fx.BASE_YEAR}
    table = bundle.kept(spark, "percentiles", inputs, parameters, lambda: {"table": _percentiles(spark, sf_dir)})["table"]
    return table.select("ISO2", "hazard", *[rate(level, 10) for level in calibrate.INTENSITY_LEVELS])


@query
def losses_from_files(spark, sf_dir):
    """Loss tables written as CSV with their published titles, read back with a schema, to intensities."""
    facts = fx.trade_facts(spark, sf_dir)
    titles = {name: title for title, name in HAZARD_COLUMNS.items()}
    tables = {
        "hazard": fx.losses_by_hazard(spark, sf_dir, facts).withColumnsRenamed(titles),
        "year": fx.losses_by_year(spark, sf_dir, facts).withColumnsRenamed({f"y{y}": str(y) for y in fx.YEARS}),
    }
    paths = {name: fresh_path(spark, f"losses-{name}") for name in tables}
    for name, df in tables.items():
        sinks.write_csv(df, paths[name])
    schema = {n: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) for n, df in tables.items()}
    by_hazard, by_year = read_losses(spark, paths["hazard"], paths["year"], "csv", schema["hazard"], schema["year"])
    panel = calibrate.intensity_panel(by_hazard, by_year, _output(spark, sf_dir, facts))
    return panel.select("ISO2", "year", "hazard", money("loss_hazard"), money("output_mn_eur"), rate("intensity", 10))


@query
def scenario_grid(spark, sf_dir):
    countries = fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("country"))
    return shocks.scenario_grid(countries, HAZARDS)


def _scalars(spark, sf_dir, clamp_max: float = 0.5) -> DataFrame:
    return calibrate.shock_scalars(scenario_grid(spark, sf_dir), _percentiles(spark, sf_dir), clamp_max)


@query
def shock_scalars(spark, sf_dir):
    # A cap inside the observed range, so that it binds for some rows.
    return _scalars(spark, sf_dir, clamp_max=0.06).select("scenario_id", "ISO2", "hazard", "level", rate("scalar", 10))


@query
def hazard_catalog(spark, sf_dir):
    return calibrate.hazard_catalog(_percentiles(spark, sf_dir))


@query
def level_order(spark, sf_dir):
    available = calibrate.level_scalars(_percentiles(spark, sf_dir)).filter(F.col("value") > 0)
    return calibrate.ordered_levels(available)


@query
def sector_catalog(spark, sf_dir):
    nodes = network.account_nodes(fx.flow_table(spark, sf_dir))
    return calibrate.catalog(nodes.filter(F.col("country") == "NATION_3"), "sector")


# --- shocks -----------------------------------------------------------------


@query
def targeted_shocks(spark, sf_dir):
    nodes = network.node_table(_newest(spark, sf_dir))
    scenarios = fx.scenarios(spark, fx.TARGETS)
    vectors = shocks.whole_vectors(shocks.targeted_shocks(scenarios, nodes), scenarios, nodes)
    return vectors.select("scenario_id", "label", rate("sd"), rate("sp"))


@query
def flat_shocks(spark, sf_dir):
    nodes = network.node_table(cut(flows.compact_flows(_newest(spark, sf_dir))))
    scalars = cut(_scalars(spark, sf_dir))
    vectors = shocks.whole_vectors(shocks.flat_shocks(scalars, nodes), scalars, nodes)
    return vectors.select("scenario_id", "label", rate("sd"), rate("sp", 10))


# --- one step ---------------------------------------------------------------


def _start(spark, sf_dir) -> tuple[network.Network, DataFrame]:
    """Network and shocked state. Required output is baseline output less the
    uniform demand cut, which is what it amounts to in the first step."""
    net = _network(spark, sf_dir)
    scenarios = fx.scenarios(spark)
    state = propagate.initial_state(net.nodes, shocks.targeted_shocks(scenarios, net.nodes), scenarios)
    return net, cut(state.withColumn("xdem", F.col("x0") * (1 - F.col("sd"))))


def _stepped(spark, sf_dir) -> tuple[network.Network, DataFrame]:
    net, state = _start(spark, sf_dir)
    return net, cut(propagate.step(net, state, GAMMA))


@query
def initial_state(spark, sf_dir):
    net, state = _start(spark, sf_dir)
    return _named(state, net, "node").select("scenario_id", "label", money("cap"), money("fd"), money("xdem"))


@query
def rationing(spark, sf_dir):
    net, state = _start(spark, sf_dir)
    return _named(propagate.with_rationing(state), net, "node").select("scenario_id", "label", rate("r"))


@query
def bottleneck(spark, sf_dir):
    net, state = _start(spark, sf_dir)
    return _named(propagate.factored_state(net, state), net, "node").select(
        "scenario_id", "label", rate("s"), rate("row_factor")
    )


@query
def inventory(spark, sf_dir):
    net, state = _start(spark, sf_dir)
    return _named(propagate.factored_state(net, state), net, "node").select("scenario_id", "label", money("inv"))


def _edge_flows(spark, sf_dir) -> tuple[network.Network, DataFrame, DataFrame]:
    net, state = _start(spark, sf_dir)
    factored = cut(propagate.factored_state(net, state))
    return net, factored, propagate.edge_flows(net, factored)


@query
def flow_balance(spark, sf_dir):
    net, _, on_edges = _edge_flows(spark, sf_dir)
    return on_edges.select("scenario_id", "i", "j", *[money(c) for c in ("con", "need", "base", "unmet")])


@query
def substitution(spark, sf_dir):
    _, factored, on_edges = _edge_flows(spark, sf_dir)
    balance = propagate.sector_balance(factored, propagate.inputs_by_sector(propagate.edge_sums(on_edges)), GAMMA)
    return balance.select("scenario_id", "globsec", money("inv_total"), money("unmet_total"), rate("sub"), rate("frac"))


@query
def sector_deliveries(spark, sf_dir):
    _, factored, on_edges = _edge_flows(spark, sf_dir)
    inputs = propagate.inputs_by_sector(cut(propagate.edge_sums(on_edges)))
    supply = propagate.sector_supply(inputs, propagate.sector_balance(factored, inputs, GAMMA))
    return supply.select("scenario_id", "globsec", "node", rate("ag"), money("delivered"), money("zg"))


@query
def global_feasibility(spark, sf_dir):
    net, stepped = _stepped(spark, sf_dir)
    return _named(stepped, net, "node").select("scenario_id", "label", money("xl"), money("xg"), money("z_col"))


@query
def first_step_state(spark, sf_dir):
    net, stepped = _stepped(spark, sf_dir)
    amounts = ("cap", "fd", "inv", "z_new_row", "xl", "xg", "xs", "fd_implied", "fd_next")
    return _named(stepped, net, "node").select(
        "scenario_id", "label", rate("r"), rate("s"), rate("inv_share"), *[money(c) for c in amounts]
    )


@query
def reallocated_edges(spark, sf_dir):
    net, stepped = _stepped(spark, sf_dir)
    final = propagate.reallocated_edges(net, stepped)
    return final.select("scenario_id", "i", "j", plain("z0"), money("z1"))


@query
def step_totals(spark, sf_dir):
    net, stepped = _stepped(spark, sf_dir)
    report = propagate.step_totals(propagate.edge_flows(net, stepped), stepped)
    return report.select("scenario_id", *[money(c, 1) for c in ("tot_con", "tot_need", "tot_new", "tot_inv", "tot_unmet")])


# --- iteration --------------------------------------------------------------


@query
def demand_output_k30(spark, sf_dir):
    net = _network(spark, sf_dir)
    scenarios = fx.scenarios(spark)
    state = propagate.initial_state(net.nodes, shocks.targeted_shocks(scenarios, net.nodes), scenarios)
    settled = required.rounds(net, cut(state.select("scenario_id", "node", F.col("fd").alias("v"))), 30)
    return _named(settled, net, "node").select("scenario_id", "label", money("v").alias("xdem"))


@query
def demand_output(spark, sf_dir):
    """Output that each scenario's demand requires, solved to a tolerance."""
    net = _network(spark, sf_dir)
    scenarios = fx.scenarios(spark)
    state = propagate.initial_state(net.nodes, shocks.targeted_shocks(scenarios, net.nodes), scenarios)
    start = cut(state.select("scenario_id", "node", F.col("fd").alias("v")))
    scale = net.nodes.agg(F.max("x")).first()[0] or 1.0
    solved = required.solve(net, start, scale, SETTLED["inner_tol"], required.shrink_ratio(net))
    return _named(solved, net, "node").select("scenario_id", "label", money("v", 1).alias("xdem"))


def _run(spark, sf_dir, **controls) -> stress.StressResult:
    net = _network(spark, sf_dir)
    scenarios = fx.scenarios(spark)
    vectors = cut(shocks.targeted_shocks(scenarios, net.nodes))
    requirements = required.total_requirements(net) if controls.get("inner_rounds") is None else None
    return stress.run(net, vectors, scenarios=scenarios, requirements=requirements, **controls)


@query
def feasible_state_k2(spark, sf_dir):
    result = _run(spark, sf_dir, **K2)
    return _named(result.nodes, result.network, "node").select(
        "scenario_id", "label", "iterations", "converged",
        *[money(c) for c in ("xdem", "xs", "xl", "xg", "fd_next", "fd_implied")],
    )


@query
def history_k2(spark, sf_dir):
    result = _run(spark, sf_dir, **K2, return_history=True)
    return _named(result.history, result.network, "node").select(
        "scenario_id", "iteration", "label", money("fd"), money("fd_implied"), money("xs")
    )


def _settled(spark, sf_dir) -> dict[str, DataFrame]:
    """Scenarios run to their settled states: ``nodes`` of the network, ``state``, ``flows``, ``gaps``, ``history``.

    The run is kept under a key of the input files, scenarios and controls.
    """

    def compute() -> dict[str, DataFrame]:
        result = _run(spark, sf_dir, **SETTLED, return_history=True)
        with network.shuffled_joins(spark):
            edges = cut(result.edges())
        return {
            "nodes": result.network.nodes, "state": result.nodes, "flows": edges,
            "gaps": result.gaps, "history": result.history,
        }

    inputs = [f"{sf_dir}/{t}.parquet" for t in FLOW_INPUTS]
    return bundle.kept(spark, "settled", inputs, {**SETTLED, "scenarios": fx.SCENARIOS}, compute)


def _labelled(df: DataFrame, nodes: DataFrame) -> DataFrame:
    return df.join(nodes.select("node", "label"), "node")


@query
def feasible_state_converged(spark, sf_dir):
    run = _settled(spark, sf_dir)
    return _labelled(run["state"], run["nodes"]).select(
        "scenario_id", "label", "iterations", "converged",
        *[money(c, 1) for c in ("xdem", "xs", "xl", "xg", "fd_next", "fd_implied")],
    )


@query
def gap_per_iteration(spark, sf_dir):
    return _settled(spark, sf_dir)["gaps"].select("scenario_id", "iteration", rate("gap", 9))


@query
def history_settled(spark, sf_dir):
    run = _settled(spark, sf_dir)
    return _labelled(run["history"], run["nodes"]).select(
        "scenario_id", "iteration", "label", money("fd", 1), money("fd_implied", 1), money("xs", 1)
    )


@query
def demand_diagnostics(spark, sf_dir):
    report = stress.demand_diagnostics(_settled(spark, sf_dir)["state"])
    amounts = ("fd_baseline", "fd_final", "fd_implied", "max_unmet", "max_slack")
    return report.select("scenario_id", "iterations", "converged", *[money(c, 1) for c in amounts])


@query
def calibrated_sweep(spark, sf_dir):
    """Every country x hazard x level scenario run to its settled state; loss by scenario."""
    net = _network(spark, sf_dir)
    scalars = cut(_scalars(spark, sf_dir))
    result = stress.run(net, cut(shocks.flat_shocks(scalars, net.nodes)), scenarios=scalars, requirements=required.total_requirements(net), **SETTLED)
    lost = F.sum(F.col("x0") - F.col("xs"))
    report = result.nodes.groupBy("scenario_id", "iterations", "converged").agg(
        lost.alias("loss_abs"), (F.lit(100.0) * lost / F.sum("x0")).alias("loss_pct")
    )
    return report.select("scenario_id", "iterations", "converged", money("loss_abs", 0), rate("loss_pct", 6))


# --- impact -----------------------------------------------------------------


def _impacts(spark, sf_dir) -> DataFrame:
    run = _settled(spark, sf_dir)
    nodes = run["nodes"]
    per_output = nodes.select("node", "sector").join(fx.employment_intensity(spark, sf_dir), "sector")
    return impact.node_impacts(run["state"], nodes, employment_per_output=per_output)


def _measures(*names: str, digits: int = 1) -> list[Column]:
    return [rate(c, 6) if c.endswith("pct") or c.endswith("pct_total") else money(c, digits) for c in names]


X_COLS = ("X_baseline", "X_final", "loss_abs", "loss_pct")
VA_COLS = ("VA_baseline", "VA_final", "VA_loss_abs", "VA_loss_pct")
EMP_COLS = ("EMP_baseline", "EMP_final", "EMP_loss_abs", "EMP_loss_pct")


@query
def node_impact(spark, sf_dir):
    return impact.by_loss(_impacts(spark, sf_dir)).select("scenario_id", "label", "country", "sector", *_measures(*X_COLS))


@query
def value_added(spark, sf_dir):
    return _impacts(spark, sf_dir).select("scenario_id", "label", *_measures(*VA_COLS))


@query
def employment(spark, sf_dir):
    return _impacts(spark, sf_dir).select("scenario_id", "label", *_measures(*EMP_COLS))


def _countries(spark, sf_dir) -> DataFrame:
    return impact.country_impacts(_impacts(spark, sf_dir))


def _sectors(spark, sf_dir) -> DataFrame:
    named = dims.decode_sectors(_impacts(spark, sf_dir), dims.sector_decoder(fx.code_dimension(spark, sf_dir)))
    return impact.sector_impacts(named)


@query
def country_impact(spark, sf_dir):
    return impact.by_loss(_countries(spark, sf_dir)).select(
        "scenario_id", "country", *_measures(*X_COLS, *VA_COLS, *EMP_COLS)
    )


@query
def sector_impact(spark, sf_dir):
    return impact.by_loss(_sectors(spark, sf_dir)).select(
        "scenario_id", "sector", "sector_name", *_measures(*X_COLS, *VA_COLS, *EMP_COLS)
    )


@query
def totals(spark, sf_dir):
    report = impact.totals(_impacts(spark, sf_dir), _settled(spark, sf_dir)["state"])
    return report.select("scenario_id", *_measures(*[c for c in report.columns if c != "scenario_id"], digits=0))


@query
def node_impact_csv(spark, sf_dir):
    impacts = _impacts(spark, sf_dir)
    path = fresh_path(spark, "node-impacts")
    sinks.write_csv(impacts, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in impacts.schema)
    back = spark.read.option("header", True).schema(schema).csv(path)
    return back.select("scenario_id", "label", *_measures(*X_COLS))


# --- links ------------------------------------------------------------------


def _changes(spark, sf_dir, metric: str) -> DataFrame:
    """Links that moved between baseline and settled state."""
    run = _settled(spark, sf_dir)
    changes = linkage.link_changes(run["flows"], run["state"], run["nodes"], metric, MOVED[metric])
    return linkage.changed_links(changes)


LINK_COLS = ("scenario_id", "i_label", "j_label")


def _ends(df: DataFrame) -> list[str]:
    return [c for c in ("rank", *LINK_COLS) if c in df.columns]


def _coefficient_links(df: DataFrame) -> DataFrame:
    return df.select(*_ends(df), *[rate(c) for c in ("baseline", "final", "delta")], rate("delta_rel", 5))


def _flow_links(df: DataFrame) -> DataFrame:
    return df.select(*_ends(df), *[money(c, 1) for c in ("baseline", "final", "delta")], rate("delta_rel", 5))


@query
def linkage_deltas_a(spark, sf_dir):
    return _coefficient_links(_changes(spark, sf_dir, "A"))


@query
def linkage_deltas_z(spark, sf_dir):
    return _flow_links(_changes(spark, sf_dir, "Z"))


@query
def links_weakened(spark, sf_dir):
    return _coefficient_links(linkage.top_links(_changes(spark, sf_dir, "A"), "weakened"))


@query
def links_strengthened(spark, sf_dir):
    return _coefficient_links(linkage.top_links(_changes(spark, sf_dir, "A"), "strengthened"))


@query
def links_weakened_large_flows(spark, sf_dir):
    top = linkage.top_links(_changes(spark, sf_dir, "Z"), "weakened", 15, 20000.0, metric="Z")
    return _flow_links(top)


@query
def links_weakened_min_baseline_a(spark, sf_dir):
    top = linkage.top_links(_changes(spark, sf_dir, "A"), "weakened", min_baseline=0.5, metric="A")
    return _coefficient_links(top)


@query
def links_combined(spark, sf_dir):
    changes = cut(_changes(spark, sf_dir, "A"))
    table = linkage.signed_link_table(
        linkage.top_links(changes, "weakened"), linkage.top_links(changes, "strengthened"), k=20
    )
    return table.select("scenario_id", "edge", "direction", rate("delta_pp", 6), rate("delta_rel_pct", 4))


@query
def result_bundle(spark, sf_dir):
    """All tables of a settled run published together, read back by the manifest: rows and sums of each."""
    run = _settled(spark, sf_dir)
    with network.shuffled_joins(spark):
        tables = suite.tables_of(
            run["state"], run["nodes"], run["flows"], dims.sector_decoder(fx.code_dimension(spark, sf_dir)),
            fx.country_dimension(spark, sf_dir), employment_per_output=run["nodes"].select("node", "sector").join(
                fx.employment_intensity(spark, sf_dir), "sector"), min_abs_delta=MOVED["A"],
        )
    # Of the ranked links those that moved to their side; the others are ties at 0.
    tables["links_weakened"] = tables["links_weakened"].filter("delta < 0")
    tables["links_strengthened"] = tables["links_strengthened"].filter("delta > 0")
    folder = fresh_path(spark, "bundle")
    with network.shuffled_joins(spark):
        bundle.publish(tables, folder)
    measure = {"totals": "X_loss_abs_total"} | {n: "delta" for n in tables if n.startswith("links")}
    parts = [
        df.groupBy("scenario_id").agg(F.count("*").cast("int").alias("n_rows"), F.sum(measure.get(name, "loss_abs")).alias("m"))
        .select(F.lit(name).alias("table_name"), "scenario_id", "n_rows", rate("m", 3 if measure.get(name) == "delta" else 0).alias("total"))
        for name, df in sorted(bundle.read_bundle(spark, folder).items())
    ]
    return reduce(DataFrame.unionByName, parts)


# --- heatmap ----------------------------------------------------------------


def _links(spark, sf_dir) -> DataFrame:
    return cut(_changes(spark, sf_dir, "A"))


def _heat(spark, sf_dir, perspective: str, aggregation: str) -> DataFrame:
    cells = heatmap.heatmap(_links(spark, sf_dir), perspective, aggregation, ["scenario_id"])
    return cells.select(
        "scenario_id", "src", "dst", *[rate(c, 7) for c in ("value", "intensity", "clip_limit", "clipped")]
    )


@query
def heatmap_sector(spark, sf_dir):
    return _heat(spark, sf_dir, "absolute", "sector")


@query
def heatmap_country(spark, sf_dir):
    return _heat(spark, sf_dir, "absolute", "country")


@query
def heatmap_country_percentage(spark, sf_dir):
    return _heat(spark, sf_dir, "percentage", "country")


@query
def heatmap_node(spark, sf_dir):
    return _heat(spark, sf_dir, "absolute", "node")


@query
def heatmap_matrix(spark, sf_dir):
    cells = heatmap.heatmap_cells(_links(spark, sf_dir), "absolute", "sector", ["scenario_id"])
    matrix = heatmap.as_matrix(cells, fx.USER_SECTORS, ["scenario_id"])
    return matrix.select("scenario_id", "src", *[rate(c, 7) for c in fx.USER_SECTORS])


@query
def heatmap_clip(spark, sf_dir):
    cells = cut(heatmap.heatmap_cells(_links(spark, sf_dir), "percentage", "node", ["scenario_id"]))
    return heatmap.clip_limits(cells, ["scenario_id"]).select("scenario_id", rate("clip_limit", 7))


@query
def heatmap_trade(spark, sf_dir):
    """Heatmap of raw order lines between nations, one link row per line."""
    lines = fx.flow_lines(spark, sf_dir).select(
        F.col("c_orig").alias("source"),
        F.col("c_dest").alias("target"),
        F.when(F.col("returnflag") == "R", -F.col("price")).otherwise(F.col("net_price")).alias("delta"),
    )
    cells = heatmap.heatmap(lines, "absolute", "node")
    return cells.select("src", "dst", money("value"), rate("intensity", 7), money("clip_limit"), money("clipped"))


@query
def heatmap_trade_detail(spark, sf_dir):
    """Heatmap of raw order lines on the grid of (country, brand) x (country, account)."""
    lines = fx.flow_lines(spark, sf_dir).select(
        node_label("c_orig", "brand").alias("origin_node"),
        node_label("c_dest", "ind_use").alias("dest_node"),
        F.when(F.col("returnflag") == "R", -F.col("price")).otherwise(F.col("net_price")).alias("delta"),
    )
    cells = heatmap.heatmap(lines, "absolute", "node")
    return cells.select("src", "dst", money("value"), rate("intensity", 7), money("clip_limit"), money("clipped"))


@query
def brand_deviation(spark, sf_dir):
    """Returned share of every (country, brand) against the mean: extremes of a long list."""
    returned = F.sum(F.when(F.col("returnflag") == "R", F.col("price")).otherwise(0.0))
    brands = (
        fx.flow_lines(spark, sf_dir)
        .groupBy(node_label("c_orig", "brand").alias("sector"))
        .agg(returned.alias("loss_abs"), F.sum("price").alias("sold"))
        .withColumn("loss_pct", plain(F.lit(100.0) * F.col("loss_abs") / F.col("sold"), 6))
    )
    d = deviation.sector_deviations(brands, k=20, keys=())
    return d.select("sector_label", "direction", money("loss_abs"), rate("loss_pct", 6), rate("loss_pct_deviation", 7))


# --- deviations, rankings, points ------------------------------------------


@query
def country_deviation(spark, sf_dir):
    d = deviation.mean_deviation(_countries(spark, sf_dir))
    return d.select("scenario_id", "country", rate("loss_pct"), rate("loss_pct_deviation"))


def _deviation_table(df: DataFrame) -> DataFrame:
    return df.select("scenario_id", "sector_label", "direction", rate("loss_pct"), rate("loss_pct_deviation"))


# Deviations are compared with zero, so loss percentages enter rounded: a
# scenario with equal losses everywhere must give exact zeros.
def _rounded_sectors(spark, sf_dir) -> DataFrame:
    return _sectors(spark, sf_dir).withColumn("loss_pct", plain("loss_pct", 6))


@query
def sector_anomalies(spark, sf_dir):
    return _deviation_table(deviation.sector_deviations(_rounded_sectors(spark, sf_dir), k=2))


@query
def sector_distribution(spark, sf_dir):
    return _deviation_table(deviation.sector_deviations(_rounded_sectors(spark, sf_dir), mode="full_distribution"))


@query
def map_table(spark, sf_dir):
    table = deviation.map_table(_countries(spark, sf_dir), fx.country_dimension(spark, sf_dir))
    return table.select(
        "scenario_id", "country", "iso3", "country_name", money("loss_abs"),
        *[rate(c) for c in ("loss_pct", "loss_pct_deviation", "range_min", "range_max")],
    )


@query
def top_countries(spark, sf_dir):
    named = dims.decode_countries(_countries(spark, sf_dir), fx.country_dimension(spark, sf_dir))
    top = deviation.top_by(named.withColumn("loss_abs", plain("loss_abs", 3)), "loss_abs", "country", k=5)
    return top.select("scenario_id", "rank", "country", "country_name", money("loss_abs"))


@query
def top_sectors(spark, sf_dir):
    sectors = _sectors(spark, sf_dir).withColumn("loss_abs", plain("loss_abs", 3))
    return deviation.top_by(sectors, "loss_abs", "sector", k=3).select(
        "scenario_id", "rank", "sector", "sector_name", money("loss_abs")
    )


BOUNDS = (5.0, 40.0, 950.0, 1500.0)


@query
def viewport_clip(spark, sf_dir):
    mapped = heatmap.map_to_viewport(fx.points(spark, sf_dir), "x", "y", BOUNDS, "clip")
    return mapped.select("point_id", "in_bounds", plain("x_mapped"), plain("y_mapped"))


@query
def viewport_drop(spark, sf_dir):
    mapped = heatmap.map_to_viewport(fx.points(spark, sf_dir), "x", "y", BOUNDS, "drop")
    return mapped.select("point_id", "in_bounds", plain("x_mapped"), plain("y_mapped"))


@query
def label_violations(spark, sf_dir):
    """Labels spoiled by customer key: second separator, blank side, no separator."""
    key = F.col("c_custkey") % 11
    label = (
        F.when(key == 1, F.concat(F.col("c_name"), F.lit("::A::B")))
        .when(key == 2, F.concat(F.col("c_name"), F.lit(":: ")))
        .when(key == 3, F.col("c_name"))
        .otherwise(F.concat_ws("::", "c_name", "c_mktsegment"))
    )
    labelled = fx.table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"))
    return checks.invalid_labels(labelled)


@query
def range_violations(spark, sf_dir):
    report = checks.range_violations(
        fx.table(spark, sf_dir, "lineitem"),
        {"l_discount": (0.0, 0.05), "l_tax": (0.0, 1.0), "l_quantity": (1.0, 40.0)},
    )
    return report.select("column_name", F.col("violations").cast("int"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shock scenarios to their settled states, then loss by country."""
    run = _settled(spark, sf_dir)
    return impact.by_loss(impact.country_impacts(impact.node_impacts(run["state"], run["nodes"])))
