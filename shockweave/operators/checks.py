"""Data-quality checks that return violations or one-row reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockweave.functions.labels import label_is_valid
from shockweave.functions.numeric import ratio_nonzero, zero_if_null


def network_sanity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sizes, minima over the whole grid, totals, accounting gap.

    A pair without an edge is a 0 in the grid, so a minimum above 0 only stands
    if every pair has an edge. The gap is output against final demand and the
    flows of the node's edges.
    """
    sold = edges.groupBy(F.col("i").alias("node")).agg(F.sum("z").alias("_sold"))
    sales = F.col("fd") + zero_if_null("_sold")
    on_nodes = nodes.join(sold, "node", "left").agg(
        F.count("*").alias("n_nodes"),
        F.min("fd").alias("min_fd"),
        F.min("x").alias("min_x"),
        F.sum("fd").alias("total_fd"),
        F.sum("x").alias("total_x"),
        F.sum(F.abs(F.col("x") - sales)).alias("accounting_gap"),
    )
    on_edges = edges.agg(
        F.count("*").alias("n_edges"),
        F.min("z").alias("min_z"),
        F.min("a").alias("min_a"),
        F.sum("z").alias("total_z"),
    )

    def grid_min(c: str):
        full = F.col("n_edges") == F.col("n_nodes") * F.col("n_nodes")
        return F.when(full, F.col(c)).otherwise(F.least(zero_if_null(c), F.lit(0.0))).alias(c)

    # Two one-row reports meet on a constant key.
    return (
        on_nodes.withColumn("_k", F.lit(1))
        .join(on_edges.withColumn("_k", F.lit(1)), "_k")
        .select(
            "n_nodes", "n_edges", grid_min("min_z"), grid_min("min_a"), "min_fd", "min_x",
            zero_if_null("total_z").alias("total_z"), "total_fd", "total_x", "accounting_gap",
        )
    )


def coefficient_gaps(edges: DataFrame, nodes: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Edges ``(i, j, share, derived, gap)`` whose given share is not ``z / x_j``."""
    users = nodes.select(F.col("node").alias("j"), F.col("x").alias("x_j"))
    derived = ratio_nonzero("z", "x_j")
    return (
        edges.join(users, "j")
        .select("i", "j", "share", derived.alias("derived"))
        .withColumn("gap", F.abs(F.col("share") - F.col("derived")))
        .filter(F.col("gap") > tol)
    )


def invalid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label is not ``country::sector``."""
    return df.filter(~label_is_valid(label))


def range_violations(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """``(column_name, violations)``: values that are missing, not finite or out of bounds."""

    def bad(c: str, low: float, high: float):
        v = F.col(c).cast("double")
        return F.coalesce(F.isnan(v) | (v < low) | (v > high), F.lit(True))

    counts = df.agg(*[F.count_if(bad(c, *b)).alias(c) for c, b in bounds.items()])
    return counts.unpivot([], list(bounds), "column_name", "violations")
