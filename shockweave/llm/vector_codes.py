"""Vector code compression by member-resident Lloyd rounds in whole numbers.

Vectors are scaled to integers and cut into consecutive parts; each part position has a
codebook. Parts live with an owner, a task that holds rows of one (position, entry, salt).
Owners add up their resident members, partial sums first, which gives the next codebook: at
most positions x entries rows, the only thing the driver sees and broadcasts. Owners then
look for the nearest entry again: parts that keep theirs stay in the file where they are,
and only parts that change entry go through the next shuffle, to the owner of their new
entry. A reader tells who has left by the codebooks so far, so staying rows are never
written again. The number of salts follows from the number of rows, so an entry that holds
all parts of its position is spread like any other.

All sums and distances are exact integers, so the result depends neither on the order of
rows nor on their distribution.

Defined results: rows whose vector is null, empty or holds null or non-finite components are
dropped, also those of another length than the vector that comes first; a length that 16
does not divide is cut at the rounded-down multiples of its sixteenth; components beyond
plus or minus 2^18 count as that bound (2^26 when scaled), so that sums fit; with fewer
rows than entries the codebook is as small; ties go to the lower index; a null vec_id comes
after all others, among rows of one vec_id their vectors decide; repeated rows each get
their row; rows without label share theirs; a table without rows gives none; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockweave.storage import cut

SCALE, BOUND = 256, 1 << 26
POSITIONS, ENTRIES, ROUNDS = 16, 64, 2
#: Members of an owner at most, about, if one entry holds all parts of its position.
OWNER_ROWS = 1 << 12
BLOCK = 1 << 14
PART = "key long, position int, entry int, part array<int>"
CODED = "key long, position int, entry int, error long"
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"

Books = list[np.ndarray]


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and the components as scaled integers in ``x``."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bounded = lambda c: F.least(F.greatest(c * float(SCALE), F.lit(float(-BOUND))), F.lit(float(BOUND)))
    return (
        vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
        .where((F.size("v") > 0) & finite)
        .select("vec_id", "label", F.transform("v", lambda c: F.floor(bounded(c)).cast("int")).alias("x"))
    )


def cuts(width: int) -> list[int]:
    return [k * width // POSITIONS for k in range(POSITIONS + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` for each row of ``x``, ties to the lower, and the squared distance."""
    index = np.zeros(len(x), np.int64)
    x, book = x.astype(np.int64), book.astype(np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 3 * x.shape[1] * most * most < 1 << 53:  # whole numbers below 2^53 are exact as doubles
        norms, turned = (book * book).sum(1).astype(float), -2.0 * book.T.astype(float)
        for k in range(0, len(x), BLOCK):
            index[k : k + BLOCK] = np.argmin(x[k : k + BLOCK].astype(float) @ turned + norms, 1)
    else:
        for k in range(0, len(x), BLOCK):
            far = np.zeros((len(x[k : k + BLOCK]), len(book)), np.int64)
            for c in range(x.shape[1]):
                gap = x[k : k + BLOCK, c : c + 1] - book[:, c]
                far += gap * gap
            index[k : k + BLOCK] = np.argmin(far, 1)
    gap = x - book[index]
    return index, (gap * gap).sum(1)


def _first_owners(books, width: int):
    """Every vector's parts with their nearest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = cuts(width)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(len(batch), width)
            for p, book in enumerate(books.value):
                part = np.ascontiguousarray(x[:, ends[p] : ends[p + 1]])
                yield _parts(batch.column("key"), np.full(len(x), p), nearest(part, book)[0], part)

    return run


def _parts(key: pa.Array, position: np.ndarray, entry: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    at = np.arange(len(part) + 1) * part.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(part.reshape(-1), pa.int32()))
    return pa.RecordBatch.from_arrays(
        [key, pa.array(position, pa.int32()), pa.array(entry, pa.int32()), lists], ["key", "position", "entry", "part"]
    )


def _by_position(batches: Iterator[pa.RecordBatch], books: list[Books]):
    """Rows of one position that kept their entry under all ``books``: keys, position, entries, parts."""
    for batch in batches:
        positions = batch.column("position").to_numpy()
        for p in np.unique(positions).tolist():
            rows = batch.take(pa.array(np.flatnonzero(positions == p)))
            entry = rows.column("entry").to_numpy()
            part = rows.column("part").flatten().to_numpy().reshape(len(rows), -1)
            for book in books:
                stay = np.flatnonzero(nearest(part, book[p])[0] == entry)
                rows, entry, part = rows.take(pa.array(stay)), entry[stay], part[stay]
            if len(rows):
                yield rows.column("key"), p, entry, part


def _staying(books):
    def run(batches):
        for key, p, entry, part in _by_position(batches, books.value):
            yield _parts(key, np.full(len(part), p), entry, part)

    return run


def _leaving(books):
    """Rows that the last of the codebooks gives another entry, with that entry."""

    def run(batches):
        for key, p, entry, part in _by_position(batches, books.value[:-1]):
            new = nearest(part, books.value[-1][p])[0]
            go = np.flatnonzero(new != entry)
            if len(go):
                yield _parts(key.take(pa.array(go)), np.full(len(go), p), new[go], part[go])

    return run


def _coded(books):
    """Entry and distance under the last of the codebooks, of rows that stayed under those before."""

    def run(batches):
        for key, p, _, part in _by_position(batches, books.value[:-1]):
            entry, error = nearest(part, books.value[-1][p])
            yield pa.RecordBatch.from_arrays(
                [key, pa.array(np.full(len(entry), p), pa.int32()), pa.array(entry, pa.int32()), pa.array(error)],
                ["key", "position", "entry", "error"],
            )

    return run


def with_owners(parts: DataFrame, salts: int) -> DataFrame:
    """The parts written by owner, members of an owner side by side."""
    salt = F.pmod(F.xxhash64("key"), F.lit(salts))
    return cut(parts.repartition("position", "entry", salt).sortWithinPartitions("position", "entry"))


def updated(members: DataFrame, books: Books) -> Books:
    """Entries replaced by the rounded-down means of their members; those without members stay."""
    longest = max(b.shape[1] for b in books)
    sums = [F.sum(F.get("part", F.lit(c)).cast("long")).alias(f"s{c}") for c in range(longest)]
    rows = members.groupBy("position", "entry").agg(F.count("*").alias("n"), *sums).collect()  # a row an entry
    new = [b.astype(np.int64) for b in books]
    for r in rows:
        book = new[r.position]
        book[r.entry] = [r[f"s{c}"] // r.n for c in range(book.shape[1])]
    return new


def lloyd(kept: DataFrame, width: int, books: Books, salts: int, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """``(key, position, entry, error)`` of all parts after ``rounds`` rounds, and the codebooks.

    ``kept`` is a written table of (key, x). Each table of parts goes with the codebooks
    under which its rows still stay where they are.
    """
    share = kept.sparkSession.sparkContext.broadcast  # codebooks only: positions x entries rows

    def over_tables(make, books_of, schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.mapInArrow(make(share(books_of(seen))), schema) for t, seen in tables])

    first = kept.select("key", "x").mapInArrow(_first_owners(share(books), width), PART)
    tables: list[tuple[DataFrame, list[Books]]] = [(with_owners(first, salts), [])]
    for r in range(rounds):
        members = [t.mapInArrow(_staying(share(seen)), PART) if seen else t for t, seen in tables]
        books = updated(reduce(DataFrame.unionByName, members), books)
        if r < rounds - 1:
            movers = over_tables(_leaving, lambda seen: [*seen, books], PART)
            tables = [(t, [*seen, books]) for t, seen in tables] + [(with_owners(movers, salts), [])]
    return over_tables(_coded, lambda seen: [*seen, books], CODED), books


def codebooks_digest(books: Books) -> str:
    numbers = (str(v) for book in books for entry in book.tolist() for v in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Per kept vector: its code, its error, the error of its label and a digest of the codebooks."""
    spark = vectors.sparkSession
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    kept = cut(kept_vectors(vectors).withColumn("key", F.monotonically_increasing_id()))
    lead = kept.select("vec_id", "x").orderBy(*order).limit(1).collect()
    if not lead:
        return spark.createDataFrame([], RESULT)
    width = len(lead[0].x)
    kept = kept.where(F.size("x") == width)
    seeds = np.array([r.x for r in kept.select("vec_id", "x").orderBy(*order).limit(ENTRIES).collect()], np.int64)
    ends = cuts(width)
    books = [seeds[:, a:b] for a, b in zip(ends, ends[1:])]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(-(-kept.count() // OWNER_ROWS), -(-partitions // POSITIONS))
    coded, books = lloyd(kept, width, books, salts)

    def half(first: int):
        bits = F.expr(f"shiftleft(cast(entry AS long), 8 * ({first + 7} - position))")
        inside = F.col("position").between(first, first + 7)
        return F.bit_or(F.when(inside, bits).otherwise(F.lit(0)))

    codes = coded.groupBy("key").agg(half(0).alias("_high"), half(8).alias("_low"), F.sum("error").alias("error"))
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    rows = cut(
        kept.select("key", "vec_id", "label")
        .join(codes, "key")
        .select("vec_id", "label", F.concat(digits("_high"), digits("_low")).alias("code"), "error")
    )
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error",
        F.lit(codebooks_digest(books)).alias("codebooks_sha256"),
    )
