"""Mixing sources to target weights by pivotal dependent rounding.

A source with target t and size s takes each of its documents t/s times on average: the
whole part for all, and the fraction as a probability. Probabilities are rounded in pairs:
words move from one document to the other, in a random direction that leaves every
expectation as it was, until one of the two probabilities is 0 or 1. The words a source
takes so stay equal to its target up to the last open document. Documents stream through
buckets of bounded size, long ones first, each leaving at most one open document; those are paired again in
buckets of buckets until one is left for a source, which is drawn by its probability.
Random numbers come from hashes of the pair, so reruns agree.

Defined results: a null or blank text has size 0 and takes nothing; a null source is a
source of its own, the last in order; a null doc_id is like any other value; repeated rows
are rounded each on their own; a table without rows gives none; other columns pass through
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockweave.llm.tables import boxed, running_totals, unboxed
from shockweave.storage import cut

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents in a bucket, and buckets in a bucket of the next level.
BUCKET = 4096
FAN = 64
MASK = (1 << 64) - 1


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``docs``, ``source_size``, ``target`` from rows of source and size.

    Targets share the sum of all sizes by weight, and none is above ``most`` times its
    source's size: target = min(most * size, level * weight) with the one level at which
    the targets add up, found by raising it until no further source reaches its limit.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = running_totals(totals.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"one": "at"}, parts)
    kinds = F.array(*[F.lit(w) for w in weights])
    ranked = cut(ranked.withColumn("weight", F.get(kinds, F.expr(f"int(at % {len(weights)})"))))
    level = None
    while True:
        reached = f"{most} * source_size <= {level!r}D * weight" if level is not None else "false"
        row = ranked.selectExpr(
            "sum(source_size) as total",
            f"sum(if({reached}, {most} * source_size, 0)) as fixed",
            f"sum(if({reached}, 0, weight)) as open",
        ).first()
        if not row.open or not row.total:
            level = level or 0.0
            break
        new = (row.total - row.fixed) / row.open
        if new == level:
            break
        level = new
    return ranked.select(
        "source", "docs", "source_size",
        F.expr(f"least(double({most} * source_size), {level!r}D * weight)").alias("target"),
    )


def _uniform(a: int, b: int) -> float:
    """A number from 0 to 1 that depends on both hashes."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def transfer(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """Moves words between two documents of sizes s and t until p or q is 0 or 1."""
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if u * (up + down) < down:
        return (1.0, q - up / t if q * t > up else 0.0) if (1 - p) * s <= q * t else (p + up / s, 0.0)
    return (0.0, q + down / t if (1 - q) * t > down else 1.0) if p * s <= (1 - q) * t else (p - down / s, 1.0)


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by source and bucket; one open document is carried from row to row.

    Each batch goes out with the open document's row, which is the only one held back.
    """
    held, group, p_held, s_held, k_held = None, None, 0.0, 0, 0

    def done(row: pa.RecordBatch, values: list[float]) -> pa.RecordBatch:
        at = row.schema.get_field_index("p")
        return row.set_column(at, row.schema.field(at), pa.array(values, pa.float64()))

    for batch in batches:
        keys = zip(*[batch.column(c).to_pylist() for c in ("source", "bucket", "p", "size", "key")])
        values, open_at = batch.column("p").to_pylist(), None
        for i, (source, bucket, p, size, key) in enumerate(keys):
            if not 0 < p < 1:
                continue
            if (source, bucket) != group:
                if held is not None:
                    yield done(held, [p_held])
                elif open_at is not None:
                    values[open_at] = p_held
                held, open_at, group, p_held, s_held, k_held = None, i, (source, bucket), p, size, key
                continue
            if held is None and open_at is None:
                open_at, p_held, s_held, k_held = i, p, size, key
                continue
            a, b = transfer(p_held, s_held, p, size, _uniform(k_held, key))
            if 0 < b < 1:  # the earlier one is settled
                if held is not None:
                    yield done(held, [a])
                else:
                    values[open_at] = a
                held, open_at, p_held, s_held, k_held = None, i, b, size, key
            else:
                values[i], p_held = b, a
                if not 0 < a < 1:
                    if held is not None:
                        yield done(held, [a])
                    else:
                        values[open_at] = a
                    held = open_at = None
        if open_at is None:
            yield done(batch, values)
        else:
            rows = done(batch, values)
            yield rows.slice(0, open_at)
            yield rows.slice(open_at + 1)
            held, open_at = batch.slice(open_at, 1), None
    if held is not None:
        yield done(held, [p_held])


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``docs``), ``size``, ``source_size``, ``target``, ``copies`` of every row.

    ``copies`` is how often the mix takes the row; ``keep`` names the columns to carry in
    ``row``, all by default.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = boxed(
        docs, keep,
        size=F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long"),
        source=F.col("source").cast("string"),
        key=F.xxhash64("doc_id", "text"),
    )
    wanted = targets(sized.select("source", "size"), weights, most).select(
        F.col("source").alias("of"), "source_size", "target",
        F.expr("if(source_size > 0, target / source_size, 0)").alias("rate"),
        F.ceil(F.col("docs") / BUCKET).alias("buckets"),
    )
    rows = sized.join(wanted, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumns(
        {"p": F.expr("if(size > 0, rate - floor(rate), 0D)"), "bucket": F.expr("pmod(key, buckets)")}
    )
    settled = None
    while True:
        rows = rows.repartition(parts, "source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), "key")
        rows = cut(rows.mapInArrow(_rounded, rows.schema))
        done = rows.where("p <= 0 or p >= 1")
        settled = done if settled is None else settled.unionByName(done)
        rows = rows.where("p > 0 and p < 1")
        top = rows.agg(F.max("bucket").alias("bucket"), F.count("*").alias("n")).first()
        if not top.n or not top.bucket:
            break
        rows = rows.withColumn("bucket", F.expr(f"bucket div {FAN}"))
    draw = F.expr("if(pmod(xxhash64(key, 'last'), 1 << 30) / double(1 << 30) < p, 1D, 0D)")
    settled = settled.unionByName(rows.withColumn("p", draw))
    return settled.select("row", "size", "source_size", "target", F.expr("cast(floor(rate) + p as long)").alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of the mix, each as often as it is taken."""
    taken = mix(docs, weights, most).where("copies > 0")
    return unboxed(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
