"""Batch feasibility job: all scenarios iterate together until each settles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shockweave.operators import propagate, required
from shockweave.operators.network import Network, hashed, interpreted, joined_by_block, ranked, shuffled_joins
from shockweave.storage import cut, discard, scratch


@dataclass(frozen=True)
class StressResult:
    """``nodes``: final state per (scenario_id, node) with ``iterations`` and ``converged``.

    ``fd_next`` is final demand after the last update, ``xs`` feasible output,
    ``z_col`` intermediate inputs. ``history`` has one row per iteration.
    """

    network: Network
    nodes: DataFrame
    gaps: DataFrame
    history: DataFrame | None
    gamma: float

    def edges(self) -> DataFrame:
        """Baseline and final flow per (scenario_id, i, j); computed on demand."""
        return propagate.reallocated_edges(self.network, self.nodes)


def demand_gap(stepped: DataFrame) -> DataFrame:
    """``(scenario_id, name, gap)``: L1 change of demand relative to its L1 size."""
    moved = F.sum(F.abs(F.col("fd_next") - F.col("fd")))
    return stepped.groupBy("scenario_id", "name").agg((moved / (F.sum(F.abs("fd")) + 1e-12)).alias("gap"))


def scenario_numbers(shocks: DataFrame, scenarios: DataFrame | None = None) -> DataFrame:
    """``(scenario_id, name)``: numbers from 0 and names of the scenarios of ``scenarios``, by default of ``shocks``.

    A run joins and adds up by number, which makes one long with a node; the name is carried along.
    """
    names = (shocks if scenarios is None else scenarios).select(F.col("scenario_id").alias("name")).distinct()
    return cut(ranked(names.filter(F.col("name").isNotNull()), ["name"], "scenario_id"))


def named(numbered: DataFrame, *columns: str) -> DataFrame:
    """``columns``, by default all, of rows that carry number and name of their scenario, under its name alone."""
    others = columns or [c for c in numbered.columns if c not in ("scenario_id", "name")]
    return numbered.select(F.col("name").alias("scenario_id"), *others)


def check_controls(gamma: float, max_iter: int, tol: float) -> None:
    if not 0.0 <= gamma <= 1.0:
        raise ValueError(f"gamma must be in [0, 1], not {gamma}")
    if max_iter <= 0:
        raise ValueError(f"max_iter must be positive, not {max_iter}")
    if tol <= 0:
        raise ValueError(f"tol must be positive, not {tol}")


def run(
    network: Network,
    shocks: DataFrame,
    gamma: float = 0.5,
    max_iter: int = 50,
    tol: float = 1e-6,
    inner_tol: float | None = None,
    inner_rounds: int | None = None,
    return_history: bool = False,
    scenarios: DataFrame | None = None,
    requirements: DataFrame | None = None,
) -> StressResult:
    """Run every scenario of ``shocks`` (scenario_id, node, sd, sp) to a feasible state.

    ``shocks`` need to list only nodes that are hit; ``scenarios`` (scenario_id) adds those
    that hit none. Required output starts from baseline output and is corrected each
    iteration by what demand changed: with ``requirements`` (``required.total_requirements``)
    in one join, else in rounds, of which later iterations need few, until no node
    moves by ``inner_tol`` times the largest output, or ``inner_rounds`` of them.
    A settled scenario leaves the active set; the driver sees counts and one size per
    iteration. Tables written on the way are removed at the end.
    """
    check_controls(gamma, max_iter, tol)
    inner_tol = inner_tol if inner_tol is not None else 1e-3 * tol
    with scratch(), shuffled_joins(network.nodes.sparkSession):
        numbers = scenario_numbers(shocks, scenarios)
        finished, gaps, seen = _iterations(network, shocks, numbers, gamma, max_iter, tol, inner_tol, inner_rounds, return_history, requirements)
        union = lambda parts: reduce(DataFrame.unionByName, parts)
        return StressResult(
            network=network,
            nodes=cut(union(finished), keep=True),
            gaps=union(gaps),
            history=cut(union(seen), keep=True) if return_history else None,
            gamma=gamma,
        )


def _iterations(network, shocks, numbers, gamma, max_iter, tol, inner_tol, inner_rounds, return_history, requirements):
    """Final states of scenarios as they settle, gaps of all iterations (written to stay), history."""
    inside = F.col("sd").between(0, 1) & F.col("sp").between(0, 1)
    sizes = Observation()
    hits = shocks.select(F.col("scenario_id").alias("name"), "node", "sd", "sp").join(numbers, "name")
    state = cut(
        propagate.initial_state(network.nodes, hits, numbers).join(numbers, "scenario_id").withColumn("xdem", F.col("x0")),
        False, sizes,
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"), F.max(F.abs("x0")).alias("largest"),
    )
    if sizes.get["outside"]:
        raise ValueError(f"{sizes.get['outside']} rows of shocks have sd or sp missing or outside [0, 1]")
    scale = required.largest(sizes) or 1.0
    ratio = required.shrink_ratio(network) if inner_rounds is None and requirements is None else 0.0
    with joined_by_block(state.sparkSession):
        missed = Observation()
        change = cut(required.residual(network, state), False, missed, F.max(F.abs("v")).alias("largest"))
    # The first guess, baseline output, is all that is required unless demand is shocked.
    met = required.largest(missed) < inner_tol * scale
    finished: list[DataFrame] = []
    gaps: list[DataFrame] = []
    history: list[DataFrame] = []
    stepped = None
    for iteration in range(1, max_iter + 1):
        before = stepped
        with scratch():
            if requirements is not None:
                correction = required.required_output(requirements, change)
            elif inner_rounds is not None:
                correction = required.rounds(network, change, inner_rounds)
            elif iteration == 1 and met:
                correction = change
            else:
                correction = required.solve(network, change, scale, inner_tol, ratio)
            with joined_by_block(state.sparkSession):
                demanded = cut(required.add_to_guess(state, correction))
                stepped = propagate.step(network, demanded, gamma)
                with interpreted(state.sparkSession):
                    stepped = cut(stepped, outer=True)
        if before is not None and not return_history:
            discard(before)
        if return_history:
            history.append(
                named(stepped.withColumn("iteration", F.lit(iteration)), "iteration", "node", "fd", "fd_implied", "xs")
            )
        settled, counts = F.col("gap") < tol, Observation()
        with joined_by_block(state.sparkSession), interpreted(state.sparkSession):
            gap = cut(
                demand_gap(stepped).withColumn("iteration", F.lit(iteration)),
                True, counts, F.count("*").alias("all"), F.count_if(~settled).alias("open"),
            )
        gaps.append(named(gap))
        last = iteration == max_iter or not counts.get["open"]
        if last or counts.get["open"] < counts.get["all"]:
            leaving = gap if last else gap.filter(settled)
            ended = leaving.select("scenario_id", F.lit(iteration).alias("iterations"), settled.alias("converged"))
            finished.append(cut(named(stepped.join(ended, "scenario_id"))))
            if last:
                break
            active = stepped.join(hashed(gap.filter(~settled).select("scenario_id")), "scenario_id", "left_semi")
        else:
            active = stepped
        change = active.select("scenario_id", "node", (F.col("fd_next") - F.col("fd")).alias("v"))
        state = active.select(
            "scenario_id", "name", "node", "globsec", "x0", "fd0", "z_row", "sd", "sp", "cap",
            F.col("fd_next").alias("fd"), "xdem",
        )
    return finished, gaps, history


def demand_diagnostics(state: DataFrame) -> DataFrame:
    """Per scenario of a result's ``nodes``: demand totals, largest unmet and largest slack demand."""
    unmet = F.col("fd_next") - F.col("fd_implied")
    return state.groupBy("scenario_id", "iterations", "converged").agg(
        F.sum("fd0").alias("fd_baseline"),
        F.sum("fd_next").alias("fd_final"),
        F.sum("fd_implied").alias("fd_implied"),
        F.max(unmet).alias("max_unmet"),
        F.max(-unmet).alias("max_slack"),
    )
