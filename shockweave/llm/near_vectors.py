"""Embedding near-duplicates: iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned on a bounded sample (TRAIN vectors) so that
the signs lose as little as possible; every vector gets its binary code from it. Codes are
cut into substrings, each a table: a vector is filed under its substring, and looked up
under it and under those that have one more bit set, so two vectors whose substrings
differ in at most one bit meet exactly once in a table. Candidates within the Hamming
radius, met in no earlier table, are then compared by their original vectors in double
precision. Length of substrings and number of tables follow from the number of vectors and
the recall wanted at the threshold.

Equal vectors are one node from the start. A crowded bucket is cut into blocks of filed
vectors which look-ups visit in turn, so no task holds a bucket. Links are counted where
they are found, and of the links of a block only a spanning set of edges goes on.

Defined results: a vector that is null, empty, zero or holds null or non-finite components,
or has no label, links with nothing and is its own component; vectors of different lengths
do not link; a null vec_id takes part, its component is the smallest id reachable; repeated
rows link with each other; a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockweave.llm.tables import components
from shockweave.storage import cut

COSINE = 0.93
RECALL = 0.99
TRAIN = 4000
ROUNDS = 30
BITS = 64
BLOCK = 2048
PAIRS = 1 << 20


def learn_rotation(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Principal axes turned so that the signs of the projections are closest to them."""
    r = np.random.default_rng(seed)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :bits]
    v, turn = x @ axes, np.linalg.qr(r.normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
        turn = left @ right
    return axes @ turn


class Codes:
    """Rotations and the plan of tables: for each its rotation, first bit and number of bits."""

    def __init__(self, sample: np.ndarray, width: int, n: float, cosine: float):
        bits = max(1, min(width, BITS))
        length = max(1, min(bits, max(8, min(20, round(math.log2(max(n, 2)))))))
        p = 1 - math.acos(cosine) / math.pi
        meet = p**length + length * (1 - p) * p ** (length - 1)
        tables = math.ceil(math.log(1 - RECALL) / math.log(1 - meet)) if meet < 1 else 1
        each = bits // length
        self.mean = sample.mean(0) if len(sample) else np.zeros(width)
        self.turns = [learn_rotation(sample - self.mean, bits, k) if len(sample) else np.eye(width)[:, :bits] for k in range(-(-tables // each))]
        self.tables = [(t // each, t % each * length, length) for t in range(tables)]
        self.radius = math.ceil(bits * (1 - p) + 4.5 * math.sqrt(bits * p * (1 - p)))

    def of(self, x: np.ndarray) -> np.ndarray:
        weights = np.uint64(1) << np.arange(self.turns[0].shape[1], dtype=np.uint64)
        return np.stack([(((x - self.mean) @ t >= 0) * weights).sum(1, dtype=np.uint64) for t in self.turns], 1)

    def part(self, codes: np.ndarray, table: int) -> np.ndarray:
        turn, first, length = self.tables[table]
        return (codes[:, turn] >> np.uint64(first)) & np.uint64((1 << length) - 1)


def units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one, short ones filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.array(column.value_lengths().to_pylist(), int)
    x = np.zeros((len(column), width))
    if len(flat):
        rows = np.repeat(np.arange(len(sizes)), sizes)
        x[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return x / np.linalg.norm(x, axis=1, keepdims=True)


FILED = "part long, tab int, word long, node long, look int, codes binary"
MET = "part long, tab int, word long, block int, node long, look int, codes binary"


def _filed(shared, width: int):
    """One row for a vector's place in each table, and those where it looks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            codes = plan.of(units(batch.column("embedding"), width))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            for t, (_, _, length) in enumerate(plan.tables):
                word = plan.part(codes, t)
                rows, words, looks = [np.arange(len(word))] * 2, [word, word], [0, 1]
                for k in range(length):
                    clear = np.flatnonzero(word >> np.uint64(k) & np.uint64(1) == 0)
                    rows.append(clear)
                    words.append(word[clear] | np.uint64(1 << k))
                    looks.append(1)
                at = pa.array(np.concatenate(rows))
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("part").take(at), pa.array(np.full(n, t, np.int32)),
                        pa.array(np.concatenate(words).astype(np.int64)), batch.column("node").take(at),
                        pa.array(np.concatenate([np.full(len(r), k, np.int32) for r, k in zip(rows, looks)])), packed.take(at),
                    ],
                    ["part", "tab", "word", "node", "look", "codes"],
                )

    return run


def _met(shared, cosine: float | None, width: int):
    """Candidates of sorted buckets: the rows that have any, or with vectors their links.

    Rows come by bucket and block, filed vectors first; of a bucket that goes on in the
    next batch only the filed rows are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, kept, told = shared.value, None, np.zeros(0, bool)
        for batch in batches:
            if kept is not None:
                batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            key = np.stack([batch.column(c).to_numpy() for c in ("part", "tab", "word", "block")], 1)
            look, node = batch.column("look").to_numpy(), batch.column("node").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint64).reshape(len(node), -1)
            weight = batch.column("weight").to_numpy() if cosine is not None else None
            x = units(batch.column("embedding"), width) if cosine is not None else None
            begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(node))))
            filed = np.bincount(group, look == 0, len(begin)).astype(np.int64)
            seen = np.zeros(len(node), bool)
            seen[: len(told)] = told
            asking = np.flatnonzero((look == 1) & (filed[group] > 0))
            if kept is not None:
                asking = asking[asking >= len(kept)]
            ends = np.cumsum(filed[group[asking]])
            at = 0
            while at < len(asking):
                last = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")), at + 1)
                some = asking[at:last]
                n = filed[group[some]]
                q = np.repeat(some, n)
                i = begin[group[q]] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                at = last
                ok = np.bitwise_count(codes[i, 0] ^ codes[q, 0]) <= plan.radius
                i, q = i[ok], q[ok]
                table, same = key[q, 1], np.zeros(len(q), bool)
                first = np.ones(len(q), bool)
                for t in range(len(plan.tables)):
                    apart = np.bitwise_count(plan.part(codes[i], t) ^ plan.part(codes[q], t))
                    first &= (apart > 1) | (t >= table)
                    same |= (t == table) & (apart == 0)
                ok = first & (node[i] != node[q]) & (~same | (node[i] < node[q]))
                i, q = i[ok], q[ok]
                if cosine is None:
                    seen[i] = seen[q] = True
                    continue
                near = [np.einsum("ij,ij->i", x[i[k : k + 50_000]], x[q[k : k + 50_000]]) >= cosine for k in range(0, len(i), 50_000)]
                ok = np.concatenate(near) if near else np.zeros(0, bool)
                i, q = i[ok], q[ok]
                links, root = np.zeros(len(node), np.int64), node.copy()
                np.add.at(links, i, weight[q])
                np.add.at(links, q, weight[i])
                while True:
                    low = np.minimum(root[i], root[q])
                    if (low == root[i]).all() and (low == root[q]).all():
                        break
                    np.minimum.at(root, i, low)
                    np.minimum.at(root, q, low)
                touched = np.unique(np.concatenate([i, q]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[touched]), pa.array(root[touched]), pa.array(links[touched])], ["node", "root", "links"]
                )
            if cosine is None:
                new = seen.copy()
                new[: len(told)] &= ~told
                yield batch.select(["part", "tab", "word", "block", "node", "look", "codes"]).filter(pa.array(new))
            hold = np.flatnonzero((group == group[-1]) & (look == 0)) if len(group) else np.zeros(0, int)
            kept, told = (batch.take(pa.array(hold)), seen[hold]) if len(hold) else (None, np.zeros(0, bool))

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("label")
    )
    fine = (
        "label is not null and embedding is not null and size(embedding) > 0 and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    )
    rows = cut(rows.withColumn("node", F.expr(f"if({fine}, xxhash64(cast(label as string), size(embedding), embedding), null)")))
    nodes = cut(
        rows.where("node is not null").groupBy("node").agg(
            F.count("*").alias("weight"), F.min("vec_id").alias("first_id"), F.any_value("embedding").alias("embedding"),
            F.xxhash64(F.any_value(F.col("label").cast("string")), F.any_value(F.size("embedding"))).alias("part"),
        )
    )
    size = nodes.agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.max(F.size("embedding")).alias("width")).first()
    width = size.width or 1
    sample = nodes.orderBy("node").limit(TRAIN).select("embedding").toArrow()["embedding"].combine_chunks()
    sample = sample if isinstance(sample, pa.Array) else pa.concat_arrays(sample.chunks)
    plan = Codes(units(sample, width), width, size.n / max(size.parts, 1), cosine)
    shared = spark.sparkContext.broadcast(plan)
    filed = cut(nodes.select("part", "node", "embedding").mapInArrow(_filed(shared, width), FILED))
    bucket = ["part", "tab", "word"]
    crowded = filed.where("look = 0").groupBy(*bucket).agg(F.count("*").alias("n")).where(f"n > {BLOCK}")
    crowded = crowded.select(*bucket, F.expr(f"int(ceil(n / {BLOCK}))").alias("blocks"))
    placed = filed.join(crowded, bucket, "left").withColumn(
        "block",
        F.explode(F.expr("case when blocks is null then array(0) when look = 0 then array(int(pmod(xxhash64(node), blocks))) else sequence(0, blocks - 1) end")),
    ).drop("blocks")
    place = [*bucket, "block"]

    def sorted_buckets(df: DataFrame) -> DataFrame:
        return df.repartition(parts, *place).sortWithinPartitions(*place, "look")

    close = cut(sorted_buckets(placed).mapInArrow(_met(shared, None, width), MET))
    full = sorted_buckets(close.join(nodes.select("node", "weight", "embedding"), "node"))
    found = cut(full.mapInArrow(_met(shared, cosine, width), "node long, root long, links long"))
    roots = components(found.where("node <> root"), "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "weight", "first_id").join(links, "node", "left").join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    ids = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(ids, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    return rows.join(known, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.expr("coalesce(vec_id = component_id, false)"))
