"""Output required by final demand: ``x = fd + A x``.

Two ways, by choice of the caller. ``solve`` repeats edge joins and needs nothing but the
edges, so it suits sparse networks of any size. ``total_requirements`` adds up all powers of
A once, to a table of (i, j) with at most a row per pair of nodes; with it required output is
one join, which pays for dense networks that see many scenarios and iterations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shockweave.functions.numeric import zero_if_null
from shockweave.operators.network import Network, hashed, joined_by_block, shuffled_joins
from shockweave.storage import cut

CHUNK = 6


def pull(net: Network, vector: DataFrame) -> DataFrame:
    """Edge contributions to ``A vector``, not yet added up per node.

    The vector is copied to the blocks its edges lie in, so the edges stay where they are.
    """
    return net.edges.select("block", "i", "j", "a").join(net.for_users(vector), ["block", "j"]).select(
        "scenario_id", F.col("i").alias("node"), (F.col("a") * F.col("v")).alias("v")
    )


def one_round(net: Network, start: DataFrame, current: DataFrame) -> DataFrame:
    """``start + A current`` for ``(scenario_id, node, v)`` tables.

    The constant part and the edge contributions go into one aggregation of
    partial sums.
    """
    parts = start.unionByName(pull(net, current))
    return parts.groupBy("scenario_id", "node").agg(F.sum("v").alias("v"))


def _round_beside(net: Network, start: DataFrame, current: DataFrame) -> DataFrame:
    """``one_round`` with ``current`` beside it as ``old``, in the same aggregation; what is missing is 0."""
    zero = F.lit(0.0)
    parts = start.unionByName(pull(net, current)).withColumn("old", zero)
    both = parts.unionByName(current.select("scenario_id", "node", zero.alias("v"), F.col("v").alias("old")))
    return both.groupBy("scenario_id", "node").agg(F.sum("v").alias("v"), F.sum("old").alias("old"))


def rounds(net: Network, start: DataFrame, steps: int, current: DataFrame | None = None) -> DataFrame:
    """``sum of A^k start`` for k = 0..steps, written every few rounds.

    ``current`` continues from an earlier sum instead of from ``start``.
    """
    current = start if current is None else current
    for k in range(1, steps + 1):
        current = one_round(net, start, current)
        if k % CHUNK == 0 and k < steps:
            with joined_by_block(start.sparkSession):
                current = cut(current)
    return current


def residual(net: Network, state: DataFrame) -> DataFrame:
    """``fd + A x - x`` for the guess ``x`` held in column ``xdem`` of ``state``."""
    guess = state.select("scenario_id", "node", F.col("xdem").alias("v"))
    gap = state.select("scenario_id", "node", (F.col("fd") - F.col("xdem")).alias("v"))
    return one_round(net, gap, guess)


def largest(seen: Observation) -> float:
    return seen.get["largest"] or 0.0


def shrink_ratio(net: Network) -> float:
    """Factor by which a round shrinks the most persistent part of an error.

    The ratio of two late terms of ``A^k x``; a property of the network, the
    same for all scenarios.
    """
    term = net.nodes.select(F.lit("all").alias("scenario_id"), "node", F.col("x").alias("v"))
    with joined_by_block(term.sparkSession):
        for _ in range(CHUNK):
            term = pull(net, term).groupBy("scenario_id", "node").agg(F.sum("v").alias("v"))
        seen = Observation()
        term = cut(term, False, seen, F.sum(F.abs("v")).alias("size"))
        following = pull(net, term).agg(F.sum(F.abs("v"))).first()[0] or 0.0
    size = seen.get["size"] or 0.0
    return following / size if size else 0.0


def solve(net: Network, start: DataFrame, scale: float, tol: float, ratio: float, max_rounds: int = 600) -> DataFrame:
    """``sum of A^k start``, until a round changes no node by ``tol * scale`` or more.

    After a few rounds what is missing is nearly a multiple of the last
    change, so it is added at once (``ratio`` is ``shrink_ratio``); a further
    round then tests the result and is kept. Derived coefficients with positive
    demand always converge; given shares need not, hence the bound.
    """
    lift = ratio / (1 - ratio) if 0 < ratio < 0.95 else 0.0
    change = F.col("v") - F.col("old")
    current = start
    with joined_by_block(start.sparkSession):
        for _ in range(0, max_rounds, CHUNK + 1):
            before = cut(rounds(net, start, CHUNK - 1, current))
            lifted = _round_beside(net, start, before).select("scenario_id", "node", (F.col("v") + change * lift).alias("v"))
            seen = Observation()
            tested = cut(_round_beside(net, start, lifted), False, seen, F.max(F.abs(change)).alias("largest"))
            current = tested.select("scenario_id", "node", "v")
            if largest(seen) < tol * scale:
                return current
    raise RuntimeError(f"required output did not settle within {max_rounds} rounds; check the coefficients")


def total_requirements(net: Network, tol: float = 1e-18, most: int = 24) -> DataFrame:
    """``(i, j, v)``: output of ``i`` that a unit of final demand for ``j`` takes, the sum of A^k.

    Doubling: from A^m and the sum below m come A^2m and the sum below 2m, both with A^m as
    left factor and so from one join. Ends when no entry of the power reaches ``tol``.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    power = cut(net.edges.filter(F.col("a") != 0).select("i", "j", F.col("a").alias("v")))
    total = net.nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), one.alias("v"))
    for _ in range(most):
        right = power.withColumn("summed", F.lit(False)).unionByName(total.withColumn("summed", F.lit(True)))
        left = power.select(F.col("i").alias("_i"), F.col("j").alias("i"), F.col("v").alias("_v"))
        parts = left.join(right, "i").select("summed", F.col("_i").alias("i"), "j", (F.col("_v") * F.col("v")).alias("v"))
        seen = Observation()
        # Few rows make many, so the join is dealt to all tasks instead of by the size of its inputs.
        with joined_by_block(power.sparkSession), shuffled_joins(power.sparkSession):
            both = cut(
                parts.unionByName(total.withColumn("summed", F.lit(True)))
                .groupBy("summed", "i", "j").agg(F.sum("v").alias("v")),
                False, seen, F.max(F.when(~F.col("summed"), F.abs("v")).otherwise(zero)).alias("largest"),
            )
        power, total = (both.filter(c).drop("summed") for c in (~F.col("summed"), F.col("summed")))
        if largest(seen) < tol:
            return total
    raise RuntimeError(f"powers of the coefficients do not vanish within {most} doublings; check the coefficients")


def required_output(requirements: DataFrame, demand: DataFrame) -> DataFrame:
    """``(scenario_id, node, v)`` from ``(scenario_id, node, v)`` of final demand."""
    users = demand.select("scenario_id", F.col("node").alias("j"), F.col("v").alias("_fd"))
    return (
        users.join(hashed(requirements), "j")
        .groupBy("scenario_id", F.col("i").alias("node"))
        .agg(F.sum(F.col("v") * F.col("_fd")).alias("v"))
    )


def add_to_guess(state: DataFrame, correction: DataFrame) -> DataFrame:
    """State with the correction added to ``xdem``."""
    fix = correction.select("scenario_id", "node", F.col("v").alias("_fix"))
    return (
        state.join(hashed(fix), ["scenario_id", "node"], "left")
        .withColumn("xdem", F.col("xdem") + zero_if_null("_fix"))
        .drop("_fix")
    )
