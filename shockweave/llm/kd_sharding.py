"""Shards from a k-d tree over metadata, split at weighted medians.

Each cell is split along its widest dimension (size on a logarithmic scale, source,
language, id) where half of its bytes lie on either side, until a leaf is a shard. A
median is found in two counts over all rows of a level: bytes by bin of the dimension,
then bytes by hash inside the bin that holds the middle, so only sums travel and a
dimension with few values still splits evenly. The driver sees one row a cell.

Equal texts are one point and stay together; a group above half a leaf cannot, and is
dealt in pieces. Points that are large for a leaf come first in the order, so that the cut
falls between small ones.

Law ``bytes``: sizes near equal; ``grown_shard`` is null. All of it is built-in functions.

Defined results: a null text has size 1 and the checksum of an empty one; null source,
language or id is a value of its own; repeated rows are rows of one group; a table without
rows gives none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockweave.llm.tables import running_totals
from shockweave.storage import cut

DEPTH = 3
BINS = 4096
FINE = 1 << 16
DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")


def _nearest(sums: DataFrame, at: str) -> DataFrame:
    """For each cell the last ``at`` of the left side and the bytes up to it.

    ``sums`` has cell, at, weight, base (bytes before the first row) and half.
    """
    up = Window.partitionBy("cell").orderBy(at)
    return sums.withColumn("upto", F.col("base") + F.sum("weight").over(up)).groupBy("cell").agg(
        F.min_by(F.struct(at, F.col("upto") - F.col("weight")), F.abs(F.col("upto") - F.col("half"))).alias("near"),
        F.min(F.when(F.col("upto") >= F.col("half"), F.struct(at, (F.col("upto") - F.col("weight")).alias("before")))).alias("middle"),
    )


def kd_shards(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` of every row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.when(F.col("text").isNull(), 1).otherwise(F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
            F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"),
        )
    )
    whole = rows.agg(
        F.sum("size").alias("bytes"), F.max("size").alias("longest"),
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
    ).first()
    leaf = (whole.bytes or 0) / 2**depth
    span = max((whole.high or 0) - (whole.low or 0), 1)
    grouped = rows.groupBy("group", "text_crc32").agg(F.sum("size").alias("bytes"))
    # Each is over half a leaf, so there are fewer than two for each leaf.
    large = grouped.where(F.col("bytes") > leaf / 2).select(
        "group", "text_crc32", F.ceil(F.col("bytes") * 64 / max(leaf, 1)).alias("pieces")
    )
    rows = rows.join(F.broadcast(large), ["group", "text_crc32"], "left").withColumn(
        "piece", F.expr("if(pieces is null, 0, pmod(xxhash64(doc_id), pieces))")
    )
    unit = lambda c: F.expr(f"(xxhash64({c}) >>> 11) / double(1L << 53)")
    points = rows.groupBy("group", "text_crc32", "piece").agg(
        F.sum("size").alias("weight"), F.min("doc_id").alias("id"), F.min("source").alias("source"),
        F.min("lang").alias("lang"), F.max("size").alias("size"),
    )
    points = cut(
        points.select(
            "group", "text_crc32", "piece", "weight", F.lit(0).alias("cell"),
            F.expr(f"log2(size + 1) / log2({(whole.longest or 1) + 2}D)").alias("d_size"),
            unit("source").alias("d_source"), unit("lang").alias("d_lang"),
            F.expr(f"coalesce((id - {whole.low or 0}L) / {span + 1}D, 0D)").alias("d_id"),
            F.expr(f"pmod(xxhash64(group, piece, 'fine'), {FINE})").alias("fine"),
        )
    )
    for _ in range(depth):
        widths = points.groupBy("cell").agg(
            F.sum("weight").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]
        ).collect()  # a row a cell
        if not widths:
            break
        by_cell = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("cell"))
        widest = {w.cell: max(DIMENSIONS, key=lambda d: w[d]) for w in widths}
        value = F.coalesce(*[F.when(F.col("cell").isin([c for c, x in widest.items() if x == d]), F.col(d)) for d in DIMENSIONS])
        half = by_cell({w.cell: w.bytes / 2 for w in widths})
        binned = points.withColumn(
            "bin", F.when(F.col("weight") > leaf / 256, -1).otherwise(F.least(F.lit(BINS - 1), (value * BINS).cast("int")))
        )
        sums = binned.groupBy("cell", "bin").agg(F.sum("weight").alias("weight"))
        middle = _nearest(sums.withColumns({"base": F.lit(0), "half": half}), "bin").select("cell", "middle.*").collect()
        bins, before = {m.cell: m.bin for m in middle}, {m.cell: float(m.before) for m in middle}
        inside = binned.where(F.col("bin") == by_cell(bins)).groupBy("cell", "fine").agg(F.sum("weight").alias("weight"))
        cuts = _nearest(inside.withColumns({"base": by_cell(before), "half": half}), "fine").select("cell", "near.fine", "middle.before").collect()
        fines = {c.cell: int(c.fine) for c in cuts}
        right = (F.col("bin") > by_cell(bins)) | ((F.col("bin") == by_cell(bins)) & (F.col("fine") > by_cell(fines)))
        points = cut(binned.withColumn("cell", F.col("cell") * 2 + right.cast("int")).drop("bin"))
    key = ["group", "text_crc32", "piece"]
    placed = rows.join(points.select(*key, F.col("cell").alias("shard")), key).select("doc_id", "size", "text_crc32", "shard", F.lit(1).alias("one"))
    ranked = cut(running_totals(placed, ["shard", "doc_id", "text_crc32"], {"one": "at"}, parts))
    first = ranked.groupBy("shard").agg(F.min("at").alias("first"))  # a row a shard
    return ranked.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
