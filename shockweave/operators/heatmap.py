"""Heatmap cells with intensity and clipping; viewport mapping of points.

Cells are kept sparse: a (src, dst) pair without a row is 0. Quantiles are
those of the full grid, whose zero cells enter by their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockweave.functions.labels import label_country, label_sector, resolve_pair
from shockweave.functions.numeric import lenient_double, zero_if_null
from shockweave.operators.quantiles import beside, nearest_quantiles
from shockweave.storage import cut

# Column pairs that may hold the two ends of a link.
LINK_ENDS = (("i_label", "j_label"), ("origin_node", "dest_node"), ("source", "target"))
PERSPECTIVES = {"absolute": "delta", "percentage": "delta_rel"}
AXES = {"node": lambda c: F.col(c).cast("string"), "country": label_country, "sector": label_sector}


def heatmap_cells(
    links: DataFrame,
    perspective: str = "absolute",
    aggregation: str = "sector",
    keys: Sequence[str] = (),
) -> DataFrame:
    """``(keys, src, dst, value)``: links added up by node, country or sector pair."""
    measure = PERSPECTIVES.get(perspective, "delta_rel")
    if measure not in links.columns:
        raise ValueError(f"links need column '{measure}' for the {perspective} view")
    if aggregation not in AXES:
        raise ValueError(f"aggregation must be one of {list(AXES)}, not {aggregation!r}")
    src, dst = resolve_pair(links, LINK_ENDS, "link end")
    axis = AXES[aggregation]
    return (
        links.select(
            *keys, axis(src).alias("src"), axis(dst).alias("dst"), zero_if_null(lenient_double(measure)).alias("v")
        )
        .groupBy(*keys, "src", "dst")
        .agg(F.sum("v").alias("value"))
    )


def _zero_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n_zeros)``: grid cells without a row, from one aggregation that deduplicates both axes first."""
    grid = F.count_distinct("src") * F.count_distinct("dst")
    return cells.groupBy(*keys).agg((grid - F.count("*")).alias("n_zeros"))


def heatmap(
    links: DataFrame,
    perspective: str = "absolute",
    aggregation: str = "sector",
    keys: Sequence[str] = (),
    cap: float = 0.95,
    clip: float = 0.98,
) -> DataFrame:
    """Cells plus ``intensity`` in [0, 1], ``clip_limit`` and ``clipped`` value.

    The cells are written first: grid size, quantiles and result all read them,
    and the links behind them should be read once.
    """
    cells = cut(heatmap_cells(links, perspective, aggregation, keys))
    return with_intensity(cells, keys, cap, clip)


def with_intensity(
    cells: DataFrame,
    keys: Sequence[str] = (),
    cap: float = 0.95,
    clip: float = 0.98,
) -> DataFrame:
    """``min(|value| / cap, 1)`` and ``value`` limited to plus or minus the clip limit."""
    group = list(keys)
    sized = cells.select(*group, F.abs("value").alias("_abs"))
    limits = nearest_quantiles(sized, group, "_abs", {"_cap": cap, "clip_limit": clip}, _zero_cells(cells, group))
    intensity = F.when(F.col("_cap") > 0, F.least(F.try_divide(F.abs("value"), F.col("_cap")), F.lit(1.0)))
    limit = F.col("clip_limit")
    clipped = F.when(limit > 0, F.least(F.greatest(F.col("value"), -limit), limit)).otherwise(F.col("value"))
    return (
        beside(cells, limits, group)
        .withColumn("intensity", F.coalesce(intensity, F.lit(0.0)))
        .withColumn("clipped", clipped)
        .drop("_cap")
    )


def clip_limits(cells: DataFrame, keys: Sequence[str], clip: float = 0.98) -> DataFrame:
    """``(keys, clip_limit)``: symmetric clipping threshold of the full grid."""
    sized = cells.select(*keys, F.abs("value").alias("_abs"))
    return nearest_quantiles(sized, keys, "_abs", {"clip_limit": clip}, _zero_cells(cells, list(keys)))


def as_matrix(cells: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Display matrix: one row per ``src``, one column per ``dst``, absent cells 0."""
    wide = cells.groupBy(*keys, "src").pivot("dst", list(columns)).agg(F.sum(value))
    return wide.na.fill(0.0, list(columns)).orderBy(*keys, "src")


def map_to_viewport(
    points: DataFrame,
    x: str,
    y: str,
    bounds: tuple[float, float, float, float],
    mode: str = "clip",
) -> DataFrame:
    """Adds ``in_bounds``, ``x_mapped``, ``y_mapped``; ``clip`` clamps, ``drop`` filters.

    ``bounds`` are (x low, x high, y low, y high).
    """
    x_low, x_high, y_low, y_high = (float(b) for b in bounds)
    xv, yv = lenient_double(x), lenient_double(y)
    inside = F.coalesce(xv.between(x_low, x_high) & yv.between(y_low, y_high), F.lit(False))
    mapped = points.withColumn("in_bounds", inside)
    if mode == "clip":

        def limited(c, low, high):
            return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))

        return mapped.withColumn("x_mapped", limited(xv, x_low, x_high)).withColumn(
            "y_mapped", limited(yv, y_low, y_high)
        )
    if mode == "drop":
        return mapped.filter("in_bounds").withColumn("x_mapped", xv).withColumn("y_mapped", yv)
    raise ValueError(f"mode must be 'clip' or 'drop', not {mode!r}")
