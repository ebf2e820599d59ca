"""One propagation step: rationing, bottlenecks, reallocation, feasibility.

Node state is keyed by (scenario_id, node) and holds

    node, globsec, x0, fd0, z_row, sp, cap, fd, xdem

where ``z_row`` is the baseline intermediate sales of the node. Flows that a
step derives live on the baseline edges only. What reallocation adds between
producer ``i`` and user ``j`` of a sector is ``share_i * delivered_j`` with
shares that sum to 1, so row sums, column sums and sector sums follow from the
two factors; the pairs are written out once, for the final tables.

What a node or edge lacks or has left over is plainly ``max(difference, 0)``, with
each difference arranged so that it is exactly 0 where no shock reaches:
baseline output is ``z_row + fd0`` and a derived coefficient ``z / x0``, so
amounts are scaled by ``xdem / x0`` and ``1 - sp`` instead of subtracted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockweave.functions.numeric import floor_zero, ratio, zero_if_null
from shockweave.operators.network import Network, hashed, joined_by_block
from shockweave.operators.shocks import per_node
from shockweave.storage import cut

# Pairs of holders and users that a task writes, about; a sector with more is spread over several.
PAIRS_PER_TASK = 1 << 18


def initial_state(nodes: DataFrame, shocks: DataFrame, scenarios: DataFrame | None = None) -> DataFrame:
    """Capacity ``x (1 - sp)`` and demand ``fd (1 - sd)`` per scenario and node.

    ``shocks`` list the nodes that are hit; here the others get their zeros. The scenarios
    are those of ``scenarios``, by default those of ``shocks``.
    """
    ids = (shocks if scenarios is None else scenarios).select("scenario_id").distinct()
    base = nodes.select("country", "node", "globsec", F.col("x").alias("x0"), F.col("fd").alias("fd0"), "z_row")
    hit = shocks.select("scenario_id", "node", "sd", "sp", F.lit(True).alias("_hit"))
    absent = F.col("_hit").isNull()
    sd, sp = (F.when(absent, F.lit(0.0)).otherwise(F.col(c)) for c in ("sd", "sp"))
    return per_node(ids, base).join(hit, ["scenario_id", "node"], "left").select(
        "scenario_id",
        "node",
        "globsec",
        "x0",
        "fd0",
        "z_row",
        sd.alias("sd"),
        sp.alias("sp"),
        (F.col("x0") * (1 - sp)).alias("cap"),
        (F.col("fd0") * (1 - sd)).alias("fd"),
    )


def with_rationing(state: DataFrame) -> DataFrame:
    """Adds ``r = min(1, cap / xdem)``, 1 where nothing is demanded."""
    covered = (1 - F.col("sp")) * F.try_divide("x0", "xdem")
    r = F.when(F.col("xdem") > 0, F.least(F.lit(1.0), covered)).otherwise(F.lit(1.0))
    return state.withColumn("r", r)


def bottlenecks(net: Network, rationed: DataFrame) -> DataFrame:
    """``(scenario_id, node, s)`` for users whose worst supplier is rationed.

    Users that are absent have ``s = 1``: suppliers with ``r = 1`` cannot lower
    a minimum that is at most 1, so only rationed ones are joined.
    """
    limited = net.for_producers(rationed.filter(F.col("r") < 1).select("scenario_id", "node", "r"))
    return (
        net.edges.filter(F.col("a") > 0)
        .select("block", "i", "j")
        .join(limited, ["block", "i"])
        .groupBy("scenario_id", F.col("j").alias("node"))
        .agg(F.min("r").alias("s"))
    )


def with_factors(rationed: DataFrame, bottleneck: DataFrame) -> DataFrame:
    """Adds ``s``, the row factor ``min(s, 1 - sp)`` and the producer's inventory.

    Inventory is capacity beyond demand and constrained sales, ``cap - fd -
    row_factor * z_row``; it is what constraints leave of intermediate sales
    and of final demand, so no edge is read for it.
    """
    factored = rationed.join(hashed(bottleneck), ["scenario_id", "node"], "left").withColumn(
        "s", F.coalesce("s", F.lit(1.0))
    )
    factored = factored.withColumn("row_factor", F.least(F.col("s"), 1 - F.col("sp")))
    unsold = F.col("z_row") * (1 - F.col("sp") - F.col("row_factor"))
    undemanded = F.col("fd0") * (1 - F.col("sp")) - F.col("fd")
    return factored.withColumn("inv", floor_zero(unsold + undemanded))


def edge_flows(net: Network, factored: DataFrame) -> DataFrame:
    """``(scenario_id, i, j, globsec, z, t, con, need, base, unmet)`` on baseline edges.

    ``need`` is ``a * xdem``; of a derived coefficient that is ``z`` times the
    change of the user's output.
    """
    producers = net.for_producers(factored.select("scenario_id", "node", "row_factor"))
    users = net.for_users(factored.select("scenario_id", "node", "xdem", "x0", F.try_divide("xdem", "x0").alias("change")))
    derived = (F.col("a") == F.col("t")) & (F.col("x0") != 0)
    change = F.col("change")
    con = F.col("z") * F.col("row_factor")
    need = F.when(derived, F.col("z") * change).otherwise(F.col("a") * F.col("xdem"))
    short = F.when(derived, F.col("z") * (change - F.col("row_factor"))).otherwise(F.col("a") * F.col("xdem") - con)
    return (
        # Producers stream past their edges, so what a producer sells in a scenario is added up in one go.
        producers.join(net.edges, ["block", "i"])
        .join(hashed(users), ["scenario_id", "block", "j"])  # the pairs of edges and scenarios are not sorted
        .select(
            "scenario_id", "i", "j", "globsec", "z", "t",
            con.alias("con"), need.alias("need"), F.least(con, need).alias("base"), floor_zero(short).alias("unmet"),
        )
    )


def edge_sums(flows: DataFrame) -> DataFrame:
    """Sums of edge flows per producer (``globsec`` NULL) and per (sector, user).

    Columns ``base, unmet, ag`` hold base flow, unmet need and the fixed
    technology. Every edge contributes to both sums, so one pass over edges
    and scenarios, with partial sums before the shuffle, serves both.
    """
    sides = [["scenario_id", "i"], ["scenario_id", "globsec", "j"]]
    return (
        flows.groupingSets(sides, "scenario_id", "globsec", "i", "j")
        .agg(F.sum("base").alias("base"), F.sum("unmet").alias("unmet"), F.sum("t").alias("ag"))
        .select("scenario_id", "globsec", F.coalesce("i", "j").alias("node"), "base", "unmet", "ag")
    )


def inputs_by_sector(sums: DataFrame) -> DataFrame:
    """``(scenario_id, globsec, node, base, unmet, ag)`` per sector and user."""
    return sums.filter(F.col("globsec").isNotNull())


def sector_balance(factored: DataFrame, inputs: DataFrame, gamma: float) -> DataFrame:
    """``(scenario_id, globsec, inv_total, unmet_total, sub, frac)``.

    ``sub`` is how much of the unmet need the sector's inventory covers, at
    most 1; ``frac = gamma * sub`` is the part that is delivered.
    """
    sector, zero = ["scenario_id", "globsec"], F.lit(0.0)
    both = factored.select(*sector, "inv", zero.alias("unmet")).unionByName(inputs.select(*sector, zero.alias("inv"), "unmet"))
    sub = F.least(F.lit(1.0), ratio("inv_total", "unmet_total"))
    return (
        both.groupBy(*sector)
        .agg(F.sum("inv").alias("inv_total"), F.sum("unmet").alias("unmet_total"))
        .withColumn("sub", sub)
        .withColumn("frac", F.lit(float(gamma)) * F.col("sub"))
    )


def sector_supply(sums: DataFrame, balance: DataFrame) -> DataFrame:
    """Per sector and user: ``delivered = frac * unmet`` and the new inflow ``zg``.

    Sales of producers (``globsec`` NULL) pass with neither; ``sold`` holds them.
    """
    return sums.join(hashed(balance.select("scenario_id", "globsec", "frac")), ["scenario_id", "globsec"], "left").select(
        "scenario_id",
        "globsec",
        "node",
        "ag",
        (F.col("frac") * F.col("unmet")).alias("delivered"),
        (F.col("base") + F.col("frac") * F.col("unmet")).alias("zg"),
        F.when(F.col("globsec").isNull(), F.col("base")).alias("sold"),
    )


def global_feasibility(supply: DataFrame) -> DataFrame:
    """``(scenario_id, node, xg, z_col, base_row)``: output the scarcest sector allows, all inputs, base sales over all users."""
    allowed = F.when(F.col("ag") > 0, F.try_divide("zg", "ag"))
    return supply.groupBy("scenario_id", "node").agg(
        F.min(allowed).alias("xg"), F.sum("zg").alias("z_col"), F.sum("sold").alias("base_row")
    )


def with_reallocation(factored: DataFrame, feasibility: DataFrame, balance: DataFrame) -> DataFrame:
    """Adds the inventory share, intermediate sales ``z_new_row``, local supply ``xl`` and what feasibility holds."""
    share = ratio("inv", "inv_total")
    return (
        factored.join(hashed(balance), ["scenario_id", "globsec"])
        .join(hashed(feasibility), ["scenario_id", "node"], "left")
        .withColumn("inv_share", share)
        .withColumn(
            "z_new_row",
            zero_if_null("base_row") + F.col("inv_share") * F.col("frac") * F.col("unmet_total"),
        )
        .withColumn("xl", F.col("fd") + F.col("z_new_row"))
    )


def with_feasible_output(reallocated: DataFrame) -> DataFrame:
    """Adds ``xs``, implied demand ``fd_implied`` and the next demand ``fd_next``."""
    return (
        reallocated.withColumn("xg", F.coalesce("xg", "xl"))
        .withColumn("z_col", zero_if_null("z_col"))
        .withColumn("xs", F.least("xl", "xg"))
        .withColumn("fd_implied", floor_zero(F.col("xs") - F.col("z_new_row")))
        .withColumn("fd_next", F.least("fd", "fd_implied"))
    )


def factored_state(net: Network, state: DataFrame) -> DataFrame:
    """State with rationing, bottleneck, row factor and inventory."""
    rationed = with_rationing(state)
    return with_factors(rationed, bottlenecks(net, rationed))


def step(net: Network, state: DataFrame, gamma: float) -> DataFrame:
    """State after one step, one row per (scenario_id, node).

    The two joins of edges with scenarios are jobs of their own; what follows
    works on their sums, a row per node or per (sector, user).
    """
    if not 0.0 <= gamma <= 1.0:
        raise ValueError(f"gamma must be in [0, 1], not {gamma}")
    with joined_by_block(state.sparkSession):
        factored = cut(factored_state(net, state))
        sums = cut(edge_sums(edge_flows(net, factored)))
    balance = sector_balance(factored, inputs_by_sector(sums), gamma)
    return with_feasible_output(with_reallocation(factored, global_feasibility(sector_supply(sums, balance)), balance))


def step_totals(flows: DataFrame, stepped: DataFrame) -> DataFrame:
    """Per scenario: constrained, needed, new, inventory and unmet totals."""
    on_edges = flows.groupBy("scenario_id").agg(
        F.sum("con").alias("tot_con"), F.sum("need").alias("tot_need"), F.sum("unmet").alias("tot_unmet")
    )
    on_nodes = stepped.groupBy("scenario_id").agg(
        F.sum("z_new_row").alias("tot_new"), F.sum("inv").alias("tot_inv")
    )
    return on_nodes.join(on_edges, "scenario_id", "left").select(
        "scenario_id",
        "tot_new",
        "tot_inv",
        *[zero_if_null(c).alias(c) for c in ("tot_con", "tot_need", "tot_unmet")],
    )


def pair_salts(holders: DataFrame, users: DataFrame) -> DataFrame:
    """``(scenario_id, globsec, salts)``: parts that a sector's users are dealt to.

    From the counted pairs of each scenario and sector, so a small sector is not copied and
    a hot one is spread over as many tasks as its pairs take.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = holders.select("scenario_id", "globsec", one.alias("h"), none.alias("u")).unionByName(
        users.select("scenario_id", "globsec", none.alias("h"), one.alias("u"))
    )
    counted = ends.groupBy("scenario_id", "globsec").agg(F.sum("h").alias("h"), F.sum("u").alias("u"))
    salts = F.least(F.ceil(F.col("h") * F.col("u") / PAIRS_PER_TASK), F.col("u"))
    return counted.filter((F.col("h") > 0) & (F.col("u") > 0)).select("scenario_id", "globsec", salts.cast("int").alias("salts"))


def reallocated_pairs(stepped: DataFrame, supply: DataFrame) -> DataFrame:
    """``(scenario_id, i, j, added)``: deliveries of a sector's inventory holders to its users.

    Every pair is a row of the result, as each holder serves each user in
    proportion to its share. Users are dealt to the sector's salts and holders copied to each.
    """
    sector = ["scenario_id", "globsec"]
    holders = stepped.filter(F.col("inv_share") * F.col("frac") > 0).select(*sector, F.col("node").alias("i"), "inv_share")
    users = supply.filter(F.col("delivered") > 0).select(*sector, F.col("node").alias("j"), "delivered")
    salts = cut(pair_salts(holders, users))
    copied = holders.join(salts, sector).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = users.join(salts, sector).withColumn("salt", F.pmod(F.hash("j"), F.col("salts")))
    return copied.drop("salts").join(dealt.drop("salts"), [*sector, "salt"]).select(
        "scenario_id", "i", "j", (F.col("inv_share") * F.col("delivered")).alias("added")
    )


def reallocated_edges(net: Network, stepped: DataFrame) -> DataFrame:
    """``(scenario_id, i, j, z0, z1)``: baseline and new flow of every edge with either.

    ``stepped`` is the output of ``step``. Edges meet the scenarios once; base flows and
    deliveries are two contributions to one sum, which also aligns baseline and final edges.
    """
    with joined_by_block(stepped.sparkSession):
        flows = cut(edge_flows(net, stepped).select("scenario_id", "i", "j", "globsec", "z", "t", "base", "unmet"))
    balance = stepped.select("scenario_id", "globsec", "frac").distinct()
    inputs = cut(inputs_by_sector(edge_sums(flows)))
    added = reallocated_pairs(stepped, sector_supply(inputs, balance))
    return (
        flows.select("scenario_id", "i", "j", F.col("z").alias("z0"), F.col("base").alias("z1"))
        .unionByName(added.select("scenario_id", "i", "j", F.lit(0.0).alias("z0"), F.col("added").alias("z1")))
        .groupBy("scenario_id", "i", "j")
        .agg(F.sum("z0").alias("z0"), F.sum("z1").alias("z1"))
    )
