"""Flow table -> node table, edge table, final demand, output, coefficients."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from math import ceil, sqrt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockweave.functions.labels import is_final_demand, is_production, node_label
from shockweave.functions.numeric import ratio_nonzero, zero_if_null
from shockweave.sources.flows import compact_flows
from shockweave.storage import cut, fresh_path

ROWS_PER_BLOCK = 1_000
MOST_SIDE = 64
BLOCKS_PER_BUCKET = 4
#: A bucket is a task, so few edges that meet many scenarios still fill a cluster.
LEAST_BUCKETS = 64


@dataclass(frozen=True)
class Network:
    """Baseline tables; written once and read by every scenario.

    ``nodes``: node, label, country, sector, globsec, fd, z_row, z_col, x.
    ``edges``: block, i, j, globsec (of i), z, a (coefficient in use), t (``z / x_j``),
    stored by block in a grid of ``side`` x ``side`` blocks.
    """

    nodes: DataFrame
    edges: DataFrame
    side: int = 1

    def for_producers(self, state: DataFrame) -> DataFrame:
        """``state`` with ``node`` as ``i``, once for each block that holds edges of the producer."""
        return self._copied(state, "i", lambda k: F.col("i") % self.side * self.side + k)

    def for_users(self, state: DataFrame) -> DataFrame:
        """``state`` with ``node`` as ``j``, once for each block that holds edges of the user."""
        return self._copied(state, "j", lambda k: k * self.side + F.col("j") % self.side)

    def _copied(self, state: DataFrame, end: str, block) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(self.side - 1))) if self.side > 1 else F.lit(0)
        return state.withColumnRenamed("node", end).withColumn("_k", copies).withColumn("block", block(F.col("_k"))).drop("_k")


def account_nodes(flows: DataFrame) -> DataFrame:
    """Distinct (country, sector) production accounts on either side of a flow.

    Both sides come out of one scan; partial ``distinct`` runs before the shuffle.
    """
    sides = F.array(
        F.when(is_production("ind_ava"), F.struct(F.col("c_orig").alias("country"), F.col("ind_ava").alias("sector"))),
        F.when(is_production("ind_use"), F.struct(F.col("c_dest").alias("country"), F.col("ind_use").alias("sector"))),
    )
    return (
        flows.select(F.explode(sides).alias("side"))
        .filter(F.col("side").isNotNull())
        .select("side.country", "side.sector")
        .distinct()
    )


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their place from 0 in the order of ``order`` as column ``name``.

    Sorted by ranges and written once with the place inside the range; the number of rows
    in the ranges before, of which there are as many as partitions, is added. No task sorts
    more than its range.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_.withColumn("_range", F.spark_partition_id()).withColumn("_inside", inside))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_inside")).cast("int").alias(name)
    return placed.join(F.broadcast(offsets), "_range").select(*rows.columns, place)  # one row a partition


def numbered(accounts: DataFrame) -> DataFrame:
    """Adds ``node``, ``label`` and ``globsec``: places in the orders of (country, sector) and of sectors.

    Only the list of sectors, the codes of a classification, is ranked as a whole.
    ``accounts`` is read twice and should be a written table.
    """
    sectors = accounts.select("sector").distinct().select(
        "sector", (F.row_number().over(W.orderBy("sector")) - 1).alias("globsec")
    )
    return (
        ranked(accounts, ["country", "sector"], "node")
        .join(sectors, "sector")
        .withColumn("label", node_label("country", "sector"))
        .select("sector", "country", *[c for c in accounts.columns if c not in ("sector", "country")], "globsec", "node", "label")
    )


def node_table(flows: DataFrame) -> DataFrame:
    """``(node, label, country, sector, globsec)`` of all production accounts."""
    return numbered(cut(account_nodes(flows)))


def edge_table(compact: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(i, j, globsec, z, share)`` between production nodes; duplicates are added up."""
    origin = nodes.select(
        F.col("node").alias("i"), F.col("country").alias("c_orig"), F.col("sector").alias("ind_ava"), "globsec"
    )
    dest = nodes.select(F.col("node").alias("j"), F.col("country").alias("c_dest"), F.col("sector").alias("ind_use"))
    return (
        compact.filter(is_production("ind_ava") & is_production("ind_use"))
        .join(origin, ["c_orig", "ind_ava"])
        .join(dest, ["c_dest", "ind_use"])
        .select("i", "j", "globsec", zero_if_null("value").alias("z"), zero_if_null("share").alias("share"))
    )


def account_sums(compact: DataFrame) -> DataFrame:
    """``(country, sector, fd, z_row, z_col, x)`` of all production accounts.

    Every flow contributes to its two ends: final demand or intermediate sales
    of the seller, inputs of the user. One aggregation gives the accounts,
    their final demand, both sums of the edge matrix and output
    ``x = z_row + fd``; what an account lacks is 0.
    """
    value, zero = zero_if_null("value"), F.lit(0.0)
    between = is_production("ind_ava") & is_production("ind_use")

    def end(country: str, sector: str, fd, z_row, z_col):
        parts = (F.col(country).alias("country"), F.col(sector).alias("sector"), fd.alias("fd"), z_row.alias("z_row"), z_col.alias("z_col"))
        return F.when(is_production(sector), F.struct(*parts))

    seller = end(
        "c_orig", "ind_ava",
        F.when(is_final_demand("ind_use"), value).otherwise(zero),
        F.when(between, value).otherwise(zero),
        zero,
    )
    user = end("c_dest", "ind_use", zero, zero, F.when(between, value).otherwise(zero))
    return (
        compact.select(F.explode(F.array(seller, user)).alias("end"))
        .filter(F.col("end").isNotNull())
        .groupBy("end.country", "end.sector")
        .agg(*[F.sum(f"end.{c}").alias(c) for c in ("fd", "z_row", "z_col")])
        .withColumn("x", F.col("z_row") + F.col("fd"))
    )


def with_coefficients(edges: DataFrame, nodes: DataFrame, method: str = "derived") -> DataFrame:
    """Adds ``t = z / x_j`` (0 at zero output) and ``a``, either ``t`` or the given share."""
    if method not in ("derived", "share"):
        raise ValueError(f"coefficients must be 'derived' or 'share', not {method!r}")
    users = nodes.select(F.col("node").alias("j"), F.col("x").alias("x_j"))
    t = ratio_nonzero("z", "x_j")
    a = t if method == "derived" else F.col("share")
    return edges.join(users, "j").select("i", "j", "globsec", "z", a.alias("a"), t.alias("t"))


def global_technology(edges: DataFrame) -> DataFrame:
    """``(globsec, j, ag)``: input from each sector, any country, per unit of output."""
    return edges.groupBy("globsec", "j").agg(F.sum("t").alias("ag"))


def grid_side(rows: int) -> int:
    """Side of the grid of blocks: about ``ROWS_PER_BLOCK`` edges a block, as each is read once per scenario."""
    return min(MOST_SIDE, max(1, ceil(sqrt(rows / ROWS_PER_BLOCK))))


def in_blocks(edges: DataFrame, side: int) -> DataFrame:
    """Edges written once by square (i, j) block, as a bucketed table.

    A block sees about ``n / side`` producers and users, which bounds what it adds to a sum
    per producer or user, and the edges of a hub lie in ``side`` blocks. Joins with node
    state copied to blocks find the edges where they are: whatever the size, edges are not
    shuffled again.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "edges")
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = max(side * side // BLOCKS_PER_BUCKET, min(side * side, LEAST_BUCKETS))
    placed = edges.withColumn("block", F.col("i") % side * side + F.col("j") % side)
    placed.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


#: A loop over placed edges is planned once: data placed by block alone serves a join on block
#: and node, and no stage waits for another plan, as nothing about sizes is left to find out.
LOOP_SETTINGS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "false",
}


#: However small, a broadcast table keyed by text takes a page of the driver's memory, up to 64 MB,
#: and a run joins hundreds; shuffled, they pass the driver by. What is shuffled for a written table
#: goes with it, else it stays on disk until the driver happens to collect its garbage.
SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


#: A process keeps 100 compiled classes, a limit that no session can change. If the plans of an iteration
#: take more, each iteration compiles them anew and runs them cold. Plans over rows of nodes are interpreted,
#: so those over edges x scenarios keep their classes.
INTERPRETED = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def hashed(few: DataFrame) -> DataFrame:
    """``few`` rows a task that a join looks up, instead of sorting both of its sides by classes of their own."""
    return few.hint("shuffle_hash")


def joined_by_block(spark: SparkSession):
    """Settings for plans over a network's edges that are made and run inside."""
    return _set(spark, LOOP_SETTINGS)


def interpreted(spark: SparkSession):
    """Settings for the plans of a loop, over nodes and not over edges, that are made and run inside."""
    return _set(spark, INTERPRETED)


def shuffled_joins(spark: SparkSession):
    """Settings for the many joins of a run, which are made and run inside without the driver."""
    return _set(spark, SHUFFLED)


def build_network(flows: DataFrame, coefficients: str = "derived") -> Network:
    """Baseline network of one period, written to the shared folder.

    The number of edges is observed while the accounts are computed.
    """
    compact = cut(compact_flows(flows))
    seen = Observation("edges")
    between = is_production("ind_ava") & is_production("ind_use")
    observed = compact.observe(seen, F.count_if(between).alias("rows"))
    with shuffled_joins(compact.sparkSession):
        nodes = cut(numbered(cut(account_sums(observed))))
        edges = with_coefficients(edge_table(compact, nodes), nodes, coefficients)
        side = grid_side(seen.get["rows"])
        return Network(nodes, in_blocks(edges, side), side)
