"""N-gram Jaccard join by T-occurrence search.

Every document is a set of word shingles. Two sets of sizes n and m reach the threshold
only if they share T shingles, so a document's lists (the documents that hold each of its
shingles) are divided: the n - T + 1 shortest ones are merged, every answer being in one of
them, and the rest, the long ones, are only probed by binary search for the candidates
found. Lists are ranked by length with a table of counters over all documents; shingles
that share a counter can only make the order worse, never lose a link, since any order
that all documents agree on is valid.

Equal sets are one class from the start. In a list of many classes not all pairs are made:
first each class meets the list's most central class (the one with the fewest rarer
shingles), and only pairs that are then still in different components are compared in
full. Components are what links reach, so leaving out pairs inside one component loses
nothing.

Defined results: a text that is null, empty or without words has no shingles and no links;
a row without doc_id takes part in links, its component is the smallest id reachable, null
if there is none; repeated rows are one class and each keeps its row; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockweave.llm.hashing import mixed, shingle_sets
from shockweave.llm.tables import boxed, components, slices, texts_of, unboxed
from shockweave.storage import cut

#: Counters for list lengths, a power of two, and how many make a row on their way.
CELLS = 1 << 21
BLOCK = 1 << 15
SALTS = 64
#: Lists up to this many classes give all their pairs at once; the others go by a central class.
SHORT = 16
PERCENT = 80

SIGNATURE = "doc_id long, key long, n int, cls long, block int, cells binary"


def _class_of(s: np.ndarray) -> int:
    """A 64-bit digest of a set; with its size it names the class."""
    both = mixed(s).sum(dtype=np.uint64) ^ np.uint64(len(s))
    return int(mixed(np.array([both], np.uint64)).view(np.int64)[0])


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, any_row = np.zeros(CELLS, np.int64), False
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts_of(batch.column("text")), size)
            held = np.concatenate(sets)
            if len(held):
                cells += np.bincount((held & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            any_row, none = True, [None] * len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([_class_of(s) for s in sets], pa.int64()),
                    pa.array(none, pa.int32()),
                    pa.array(none, pa.binary()),
                ],
                ["doc_id", "key", "n", "cls", "block", "cells"],
            )
        for k in range(CELLS // BLOCK if any_row else 0):
            row = cells[k * BLOCK : (k + 1) * BLOCK].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())]
                + [pa.array([k], pa.int32()), pa.array([row], pa.binary())],
                ["doc_id", "key", "n", "cls", "block", "cells"],
            )

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
            sums[block] = sums.get(block, 0) + np.frombuffer(cells, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
        ["block", "cells"],
    )


def list_lengths(signed: DataFrame) -> np.ndarray:
    """One byte for each counter: four times the binary logarithm of its count.

    Counters are summed on executors in two rounds, each a stream of fixed-size rows;
    the result has CELLS bytes whatever the input.
    """
    rows = signed.where("block is not null").select(
        "block", "cells", (F.spark_partition_id() % SALTS).alias("salt")
    )
    first = rows.repartition("block", "salt").select("block", "cells").mapInArrow(_summed, "block int, cells binary")
    total = first.repartition("block").mapInArrow(_summed, "block int, cells binary")
    levels = np.zeros(CELLS, np.uint8)
    for row in total.toLocalIterator():
        counts = np.frombuffer(bytes(row.cells), np.int64)
        levels[row.block * BLOCK : (row.block + 1) * BLOCK] = (4 * np.log2(counts + 1)).astype(np.uint8)
    return levels


def _short_lists(levels, size: int, percent: int):
    """Rows of the inverted lists to be merged: shingle, class, set size, rank in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, done = levels.value, set()
        for batch in slices(batches, "text"):
            parts = []
            for s in shingle_sets(texts_of(batch.column("text")), size):
                name = (_class_of(s), len(s))
                if not len(s) or name in done:
                    continue
                done.add(name)
                n = len(s)
                rank = (level[s & np.uint64(CELLS - 1)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                order = np.argsort(rank, kind="stable")[: n - (percent * n + 99) // 100 + 1]
                parts.append((s[order].view(np.int64), name[0], n))
            if parts:
                counts = [len(p[0]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[0] for p in parts])),
                        pa.array(np.repeat(np.array([p[1] for p in parts], np.int64), counts)),
                        pa.array(np.repeat(np.array([p[2] for p in parts], np.int32), counts)),
                        pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in counts])),
                    ],
                    ["h", "cls", "n", "rank"],
                )

    return run


def _can_link(percent: int, n: str, m: str, rank_n: str, rank_m: str) -> str:
    """Sizes allow the threshold, and enough shingles stand after this one in both orders."""
    return (
        f"100 * {n} >= {percent} * {m} and 100 * {m} >= {percent} * {n} and "
        f"(1 + least({n} - {rank_n}, {m} - {rank_m}) - 1) * {100 + percent} >= {percent} * ({n} + {m})"
    )


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts_of(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "shingles"]
            )

    return run


def _probed(percent: int):
    """Probes each candidate's long lists by binary search and keeps what reaches T."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int(np.count_nonzero(b[at] == a))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``key``, ``n``, ``cls`` of every row; ``cls``, ``root``, ``component_id`` of every class."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    signed = cut(docs.mapInArrow(_signatures(size), SIGNATURE))
    rows = signed.where("block is null").select("doc_id", "key", "n", "cls")
    levels = spark.sparkContext.broadcast(list_lengths(signed))

    by_shingle = Window.partitionBy("h")
    posted = docs.select("text").mapInArrow(_short_lists(levels, size, percent), "h long, cls long, n int, rank int")
    lists = cut(
        posted.withColumns(
            {
                "held": F.count("*").over(by_shingle),
                "least": F.min("cls").over(by_shingle),
                "most": F.max("cls").over(by_shingle),
                "hub": F.min(F.struct("rank", "cls", "n")).over(by_shingle),
            }
        )
        .where("least <> most")
        .select("h", "cls", "n", "rank", "held", "hub")
    )

    def pairs(left: DataFrame, right: DataFrame, extra: str = "true") -> DataFrame:
        """Pairs of classes that meet in a list and can link."""
        return (
            left.alias("l")
            .join(right.alias("r"), F.col("l.h") == F.col("r.h"))
            .where(f"(l.cls <> r.cls or l.n <> r.n) and {_can_link(percent, 'l.n', 'r.n', 'l.rank', 'r.rank')} and {extra}")
            .select(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b"))
        )

    short = lists.where(f"held <= {SHORT}").select("h", "cls", "n", "rank")
    to_hub = (
        lists.where(f"held > {SHORT} and cls <> hub.cls and {_can_link(percent, 'n', 'hub.n', 'rank', 'hub.rank')}")
        .select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b"))
    )
    members = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"))

    def linked(candidates: DataFrame) -> DataFrame:
        """The candidates that reach the threshold; one text of each class is read again.

        It is found by doc_id and hash, as an id may be null or stand for several texts.
        """
        candidates = cut(candidates.distinct())
        wanted = candidates.select(F.col("a").alias("cls")).unionByName(candidates.select(F.col("b").alias("cls")))
        one = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key")).alias("one")
        named = rows.join(wanted.distinct(), "cls", "left_semi").groupBy("cls").agg(one).select("cls", "one.doc_id", "one.key")
        named = named.withColumnsRenamed({"doc_id": "named_id", "key": "named_key"})
        sets = cut(docs.join(named, F.expr("key = named_key and doc_id <=> named_id")).dropDuplicates(["cls"]).select("cls", "text").mapInArrow(_sets(size), "cls long, shingles binary"))
        left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left"))
        right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right"))
        return candidates.join(left, "a").join(right, "b").mapInArrow(_probed(percent), "a long, b long")

    links = cut(linked(pairs(short, short, "l.cls < r.cls").unionByName(to_hub)))
    found = components(links, "a", "b")
    # Long lists whose classes are not in one component yet.
    rest = (
        lists.where(f"held > {SHORT}").select("h", "cls", "n", "rank")
        .join(found.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
        .withColumn("low", F.min("root").over(by_shingle))
        .withColumn("high", F.max("root").over(by_shingle))
        .where("low <> high")
        .select("h", "cls", "n", "rank", "root")
    )
    across = cut(pairs(rest, rest, "l.root < r.root").distinct())
    if not across.isEmpty():
        found = components(links.unionByName(linked(across)), "a", "b")
    first = found.withColumnRenamed("node", "cls").join(members, "cls", "left")
    reach = first.join(first.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    classes = members.join(reach.select("cls", "root", "component_id"), "cls", "left").select(
        "cls", F.coalesce("root", "cls").alias("root"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    return rows, classes


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs``."""
    rows, classes = _classes(docs, size, percent)
    return (
        rows.join(classes, "cls", "left")
        .select(
            "doc_id",
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, nulls last, then of the smallest hash.

    A document is a doc_id and a text, so different texts of one id are told apart and
    repeated rows stay once. Rows whose texts have no shingles stay, those without doc_id all of them.
    """
    rows, classes = _classes(docs, size, percent)
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key")).alias("first")
    held = rows.where("n > 0").join(classes.select("cls", "root"), "cls").groupBy("root").agg(first)
    blank = rows.where("n = 0").select("doc_id", "key").distinct()
    name = lambda doc_id, key: F.xxhash64(F.isnull(doc_id), doc_id, key).alias("name")
    kept = held.select(name("first.doc_id", "first.key"), F.lit(False).alias("every")).unionByName(
        blank.select(name("doc_id", "key"), F.isnull("doc_id").alias("every"))
    )
    one = Window.partitionBy("name").orderBy("name")
    rows = boxed(docs, id=F.col("doc_id").cast("long"), key=F.xxhash64(F.col("text").cast("string")))
    rows = rows.select("row", name("id", "key")).join(kept, "name").withColumn("n", F.row_number().over(one))
    return unboxed(rows.where("n = 1 or every"))
