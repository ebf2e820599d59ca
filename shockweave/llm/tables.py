"""Reading the tables, rows into and out of Arrow tasks, running totals, components."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shockweave.storage import cut


ROOT = str(Path(__file__).resolve().parent.parent.parent)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """``row``, a struct of the columns of ``docs``, and further columns that so can't clash with them."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns])
    return docs.select(row.alias("row"), *[c.alias(name) for name, c in columns.items()])


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def texts_of(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``most`` bytes of ``column``.

    A text longer than that makes a piece of its own, so that what a task holds
    besides the batch depends on one text only.
    """
    for batch in batches:
        sizes = [0 if x is None else x for x in pyarrow.compute.binary_length(batch.column(column)).to_pylist()]
        begin = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)


def running_totals(rows: DataFrame, order: list, sums: dict[str, str], partitions: int) -> DataFrame:
    """``rows`` in the total order ``order``, with the sum of all rows before each.

    ``sums`` maps a column to the name of its running total; the totals do not depend
    on where the ranges were cut. Rows are sorted by range and written once with their
    range number, so every later reader sees the same ranges; sums by range are added
    up over the ranges, of which there are as many as partitions, and inside a range
    in a window of its own.
    """
    placed = cut(
        rows.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    by_range = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_range.select(
        "_range", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_base_{c}") for c in sums]
    )
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(F.broadcast(bases), "_range")  # one row a partition
    for c, name in sums.items():
        total = F.col(f"_base_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
        placed = placed.withColumn(name, total.cast("long"))
    return placed.drop("_range", "_at", *[f"_base_{c}" for c in sums])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root``: the smallest node reachable, for every node of ``edges``.

    Large-star and small-star steps in turn: each node hangs its neighbours below its
    smallest one until nothing changes, which takes a number of rounds that grows with
    the logarithm of the longest path. A round is partial minima and joins, so a node
    with very many neighbours is pre-aggregated and its join can be split; its edges
    are written to the shared folder, and the driver sees a count and a checksum only.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    )
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen or not state.n:
            break
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .unionByName(least.withColumnRenamed("m", "b"))
        )
        now = cut(small.where("a <> b").distinct())
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
