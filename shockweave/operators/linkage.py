"""Changes of single links between baseline and final flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockweave.functions.labels import edge_caption, resolve_pair
from shockweave.functions.numeric import lenient_double, ratio_nonzero

MIN_ABS_DELTA = 1e-12
LINK_ENDS = (("i_label", "j_label"), ("origin_node", "dest_node"))


def link_changes(
    edges: DataFrame,
    final: DataFrame,
    nodes: DataFrame,
    metric: str = "A",
    min_abs_delta: float = MIN_ABS_DELTA,
) -> DataFrame:
    """Every link with its baseline, final, delta and relative delta.

    ``edges`` holds (scenario_id, i, j, z0, z1); metric ``A`` divides each
    flow by the user's output before and after, ``Z`` compares flows. Deltas up
    to ``min_abs_delta`` are rounding and count as 0.
    """
    metric = metric.upper()
    if metric == "A":
        users = final.select("scenario_id", F.col("node").alias("j"), "x0", "xs")
        edges = edges.join(users, ["scenario_id", "j"])
        base, after = ratio_nonzero("z0", "x0"), ratio_nonzero("z1", "xs")
    elif metric == "Z":
        base, after = F.col("z0"), F.col("z1")
    else:
        raise ValueError(f"metric must be 'A' or 'Z', not {metric!r}")
    delta = F.col("final") - F.col("baseline")
    labels = nodes.select("node", "label")
    return (
        edges.select("scenario_id", "i", "j", base.alias("baseline"), after.alias("final"))
        .withColumn("delta", F.when(F.abs(delta) > min_abs_delta, delta).otherwise(F.lit(0.0)))
        .withColumn("delta_rel", ratio_nonzero("delta", "baseline"))
        .join(labels.withColumnsRenamed({"node": "i", "label": "i_label"}), "i")
        .join(labels.withColumnsRenamed({"node": "j", "label": "j_label"}), "j")
        .select("scenario_id", "i", "j", "i_label", "j_label", "baseline", "final", "delta", "delta_rel")
    )


def changed_links(changes: DataFrame) -> DataFrame:
    """Links that moved; the sparse table behind heatmaps."""
    return changes.filter(F.col("delta") != 0)


def mask_small_baseline(changes: DataFrame, min_baseline: float) -> DataFrame:
    """Flows below ``min_baseline`` count as 0 and unchanged; ``delta_rel`` keeps its value."""
    if min_baseline <= 0:
        return changes
    large = F.col("baseline") >= min_baseline

    def kept(c: str):
        return F.when(large, F.col(c)).otherwise(F.lit(0.0))

    return changes.withColumns({"delta": kept("delta"), "final": kept("final"), "baseline": kept("baseline")})


def top_links(
    changes: DataFrame, side: str, k: int = 25, min_baseline: float = 0.0, metric: str = "Z"
) -> DataFrame:
    """The ``k`` most weakened or strengthened links of each scenario, with their ``rank``.

    ``min_baseline`` is an amount and masks flows (metric ``Z``) only; coefficients
    (metric ``A``) are ranked as they are.

    Signs are not filtered; ties go by (i, j). The rank limit is applied inside
    each task before the shuffle.
    """
    if side not in ("weakened", "strengthened"):
        raise ValueError(f"side must be 'weakened' or 'strengthened', not {side!r}")
    first = F.asc("delta") if side == "weakened" else F.desc("delta")
    rank = F.row_number().over(W.partitionBy("scenario_id").orderBy(first, "i", "j"))
    masked = mask_small_baseline(changes, min_baseline) if metric.upper() == "Z" else changes
    return masked.withColumn("rank", rank).filter(F.col("rank") <= k)


def signed_link_table(weakened: DataFrame, strengthened: DataFrame, k: int = 20) -> DataFrame:
    """``(scenario_id, edge, delta_pp, delta_rel_pct, direction)`` of both sides, lowest first."""

    def side(df: DataFrame, direction: str) -> DataFrame:
        i, j = resolve_pair(df, LINK_ENDS, "link end")
        if "delta" not in df.columns:
            raise ValueError("links need column 'delta'")
        relative = F.lit(100.0) * lenient_double("delta_rel") if "delta_rel" in df.columns else F.lit(None).cast("double")
        return df.filter(F.col("rank") <= k).select(
            "scenario_id",
            edge_caption(i, j).alias("edge"),
            (F.lit(100.0) * lenient_double("delta")).alias("delta_pp"),
            relative.alias("delta_rel_pct"),
            F.lit(direction).alias("direction"),
        )

    return (
        side(weakened, "Weakened")
        .unionByName(side(strengthened, "Strengthened"))
        .orderBy("scenario_id", "delta_pp", "edge")
    )
