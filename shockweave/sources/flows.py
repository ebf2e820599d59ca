"""Flow table: scan, period selection and one-pass compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockweave.functions.numeric import nan_to_null
from shockweave.storage import cut

FLOW_KEYS = ("c_orig", "ind_ava", "c_dest", "ind_use")


def read_flows(spark: SparkSession, table: str | None = None, path: str | None = None) -> DataFrame:
    """Long flow table from the catalog or from parquet files."""
    if (table is None) == (path is None):
        raise ValueError("name either a table or a path")
    return spark.table(table) if table is not None else spark.read.parquet(path)


def latest_period(flows: DataFrame, period: str = "time_period", at_most: DataFrame | None = None) -> DataFrame:
    """Rows of the newest period.

    The maximum is a scalar subquery, so nothing is collected and, on a table
    partitioned by period, it prunes partitions before the scan. Flows that are costly to
    make come with ``at_most``, a row with the newest period they can have: if there are
    flows of it, they are the result, made and written once without those of other periods.
    """
    if at_most is not None:
        found = cut(flows.filter(F.col(period) == at_most.scalar()))
        if not found.isEmpty():
            return found
    newest = flows.agg(F.max(period)).scalar()
    return flows.filter(F.col(period) == newest)


def compact_flows(flows: DataFrame) -> DataFrame:
    """One row per (origin account, destination account) with summed measures.

    Everything downstream needs only these sums, so the big table is scanned
    and shuffled once; map-side partial sums keep a hot account pair small.
    """
    share = nan_to_null("share") if "share" in flows.columns else F.lit(None).cast("double")
    return (
        flows.select(*FLOW_KEYS, nan_to_null("value").alias("value"), share.alias("share"))
        .groupBy(*FLOW_KEYS)
        .agg(F.sum("value").alias("value"), F.sum("share").alias("share"))
    )


def load_latest_flows(spark: SparkSession, table: str) -> DataFrame:
    """Newest period of a catalog flow table."""
    return latest_period(read_flows(spark, table=table))
