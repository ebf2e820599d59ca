"""Benchmark decontamination by template windows.

Texts become templates: numbers, names inside a sentence and units after a number turn into
typed placeholders, all else is lower-cased words. Windows of WINDOW template tokens are
hashed; a document's windows are kept if their hash is one of the benchmark's, and only
those few are joined with the benchmark's windows. Since capitals alone tell names, each
window is hashed three ways: with names inside sentences as placeholders, with capitalised
words that open a sentence too, and without regard to case, where only numbers and units
are placeholders, or nothing if that leaves fewer than LITERALS words. So every window of
an item can match. Windows that keep the same distance
between document and item are one alignment; its slots are consistent if equal values of
the item stand for equal values of the document, so a question with other numbers or names
is found and a chance mixture is not. Where a value of the item stands for several, the one
of most of its places counts, if there is one, and windows with another are dropped. A
document is contaminated by an item if what is left covers SHARE of the item's windows, or
SHARE of those that have LITERALS words besides their placeholders.

The benchmark's hashes are broadcast in blocks of BLOCK hashes, one pass over the documents
each, so the broadcast has a fixed bound whatever the benchmark's size.

Defined results: null and empty texts match nothing; an item of fewer than WINDOW tokens is
one window of its length; one with fewer than LITERALS tokens is not searched; a null doc_id or item_id is reported like any other; repeated rows are one;
an empty benchmark finds nothing; other columns are not read, and pass through
``clean_documents`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockweave.llm.hashing import LOWER, joined, runs, span_hashes, windows
from shockweave.llm.tables import boxed, slices, texts_of, unboxed
from shockweave.storage import cut

WINDOW = 8
LITERALS = 4
SHARE = 0.5
BLOCK = 1 << 20

#: Units that may follow a number, in natural order.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres mg g kg gram grams kilogram kilograms "
    "ounce ounces pound pounds ton tons ml l liter liters litre litres second seconds minute minutes hour hours day days "
    "week weeks month months year years dollar dollars euro euros cent cents percent degrees"
).split()

TOKEN, DIGIT, STOP, CAPITAL = (np.zeros(256, bool) for _ in range(4))
DIGIT[48:58] = True
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True
STOP[list(b".!?:;\n\r")] = True
CAPITAL[65:91] = True


def hashes_of(words: list[str]) -> np.ndarray:
    data, offsets = joined([w.encode() for w in words])
    return span_hashes(data, offsets[:-1], offsets[1:] - 1)


NUMBER, NAME, UNIT = hashes_of(["\0number", "\0name", "\0unit"])
UNIT_WORDS = np.sort(hashes_of(UNITS))


def template(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Template tokens of three kinds, the words behind them, and where the tokens of each text start.

    Names are capitalised words inside a sentence, all capitalised words, or none.
    """
    data, offsets = joined(texts)
    before, after = np.append(np.uint8(32), data[:-1]), np.append(data[1:], np.uint8(32))
    inner = ((data == 46) | (data == 44)) & DIGIT[before] & DIGIT[after]  # 3.5 and 1,000
    starts, ends = runs(TOKEN[data] | inner)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * 3, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    latin = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)  # capital Latin-1 letters
    words = span_hashes(LOWER[data] + np.where(latin, 32, 0).astype(np.uint8), starts, ends)
    figures = np.concatenate(([0], np.cumsum(DIGIT[data] | inner)))
    stops = np.concatenate(([0], np.cumsum(STOP[data])))
    number = figures[ends] - figures[starts] == ends - starts
    first = np.searchsorted(starts, offsets)
    opens = np.zeros(len(starts) + 1, bool)
    opens[first] = True
    opens = opens[:-1]
    inside = ~opens & (stops[starts] == stops[np.append(0, ends[:-1])])
    capital = CAPITAL[data[starts]] | latin[np.minimum(starts + 1, len(data) - 1)]
    unit = np.append(False, number[:-1]) & ~opens
    unit &= UNIT_WORDS[np.minimum(np.searchsorted(UNIT_WORDS, words), len(UNIT_WORDS) - 1)] == words
    kinds = [np.where(number, NUMBER, np.where(unit, UNIT, np.where(n, NAME, words))) for n in (capital & inside, capital, capital & False)]
    return kinds, words, first


def _windows(keys, lengths: list[int], columns: list[str]):
    """Rows (columns, h, pos, slots, places, able, n, n_able) of all windows, or of those whose hash is in ``keys``.

    ``places`` are the positions of the slots; ``able`` windows have LITERALS words besides placeholders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if keys is None else keys.value
        if wanted is not None:
            maybe = np.zeros(1 << 16, bool)
            maybe[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in slices(batches, "text"):
            kinds, words, first = template(texts_of(batch.column("text")))
            counts = np.diff(first)
            of_token = np.repeat(np.arange(len(counts)), counts)
            helds = [np.isin(codes, np.array([NUMBER, NAME, UNIT])) for codes in kinds]
            sums = [np.concatenate(([0], np.cumsum(held))) for held in helds]
            found, able_of = [], np.zeros(len(counts), np.int64)
            for size in lengths:
                n = max(len(words) - size + 1, 0)
                whole = of_token[:n] == of_token[size - 1 :]
                if size < WINDOW:
                    whole &= counts[of_token[:n]] == size if wanted is None else True
                enough = [size - (slot[size:] - slot[:n]) >= LITERALS if n else np.zeros(0, bool) for slot in sums]
                able = enough[0] | enough[1] | enough[2]
                able_of += np.bincount(of_token[:n][whole & able], minlength=len(counts))
                h = [windows(codes, size) for codes in kinds]
                done = []
                # Without regard to case, and literally where that leaves too few words.
                for kind, keys_of, ok in ((0, h[0], enough[0]), (1, h[1], enough[1]), (2, h[2], enough[2]), (3, windows(words, size), ~enough[2])):
                    ok = ok & whole
                    for other, used in done:
                        ok &= ~(used & (other == keys_of))
                    done.append((keys_of, ok))
                    if wanted is not None and n:
                        at = np.flatnonzero(ok & maybe[(keys_of & np.uint64(0xFFFF)).astype(np.int64)])
                        k = np.minimum(np.searchsorted(wanted, keys_of[at]), len(wanted) - 1)
                        at = at[wanted[k] == keys_of[at]]
                    else:
                        at = np.flatnonzero(ok)
                    found.append((keys_of[at], at, np.full(len(at), size), np.full(len(at), kind), able[at]))
            h, at, size, kind, able = (np.concatenate(x) for x in zip(*found))
            of = of_token[at]
            held_at = [
                a + np.flatnonzero(helds[k][a : a + s]) if k < 3 else np.zeros(0, np.int64)
                for a, s, k in zip(at.tolist(), size.tolist(), kind.tolist())
            ]
            slots = [words[x].view(np.int64) for x in held_at]
            places = [(x - f).astype(np.int32) for x, f in zip(held_at, first[of].tolist())]
            short = np.where(counts < WINDOW, 1, counts - WINDOW + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pa.array(of)) for c in columns],
                    pa.array(h.view(np.int64)),
                    pa.array(at - first[of], pa.int32()),
                    pa.array(slots, pa.list_(pa.int64())),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(able, pa.bool_()),
                    pa.array(short[of], pa.int32()),
                    pa.array(able_of[of], pa.int32()),
                ],
                [*columns, "h", "pos", "slots", "places", "able", "n", "n_able"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_windows``, ``n_matched``, ``n_changed`` and ``key`` of every contaminated row.

    ``n_changed`` counts slots of the item that have another value in the document; ``key``
    is the hash of doc_id and text.
    """
    spark = docs.sparkSession
    rest = "h long, pos int, slots array<long>, places array<int>, able boolean, n int, n_able int"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = cut(items.mapInArrow(_windows(None, list(range(LITERALS, WINDOW + 1)), ["item_id"]), f"item_id long, {rest}"))
    total = items.select("h").distinct().count()
    rows = docs.select(
        F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    lengths = sorted({min(WINDOW, r.n_tokens) for r in items.selectExpr(f"if(n > 1, {WINDOW}, 0) as n_tokens").distinct().collect()} - {0})
    lengths = sorted({*lengths, *([*range(LITERALS, WINDOW + 1)] if not items.where("n = 1").isEmpty() else [])})
    hits = None
    blocks = -(-total // BLOCK)
    for block in range(blocks):
        keys = [r.h for r in items.where(f"pmod(xxhash64(h), {blocks}) = {block}").select("h").distinct().toLocalIterator()]
        shared = spark.sparkContext.broadcast(np.unique(np.array(keys, np.int64).view(np.uint64)))  # about BLOCK hashes
        found = rows.mapInArrow(_windows(shared, lengths, ["key", "doc_id"]), f"key long, doc_id long, {rest}")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], f"key long, doc_id long, {rest}")
    hits = hits.drop("places", "able", "n", "n_able").dropDuplicates(["key", "pos", "h"])
    item = items.select("h", "item_id", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "places", "able", "n", "n_able")
    pairs = cut(hits.join(item, "h").withColumn("shift", F.col("pos") - F.col("item_pos")).drop("h", "pos"))
    same = ["key", "item_id", "shift"]
    both = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    zipped = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"), F.col("places").alias("place"))
    slots = pairs.select(*same, F.explode(zipped).alias("s")).select(*same, "s.*").distinct()
    slots = slots.groupBy(*same, "a", "b").agg(F.count("*").alias("k"))
    slots = slots.withColumn("good", 2 * F.col("k") > F.sum("k").over(Window.partitionBy(*same, "a")))
    slots = slots.groupBy(*same).agg(
        F.collect_list(F.when(~F.col("good"), F.struct("a", "b"))).alias("bad"), F.count_if(F.expr("good and a <> b")).alias("changed")
    )
    whole = pairs.withColumn("both", both).alias("p").join(
        slots.alias("s"), F.expr("p.key = s.key and p.item_id <=> s.item_id and p.shift = s.shift"), "left"
    ).where("s.bad is null or not arrays_overlap(p.both, s.bad)")
    least = F.least(F.lit(3), F.col("n_windows"))
    return (
        whole.groupBy("p.key", "p.doc_id", "p.item_id")
        .agg(
            F.max("p.n").cast("long").alias("n_windows"), F.count_distinct("p.item_pos").alias("n_matched"),
            F.max(F.coalesce("s.changed", F.lit(0))).alias("n_changed"),
            F.max("p.n_able").alias("n_able"), F.count_distinct(F.when(F.col("p.able"), F.col("p.item_pos"))).alias("able"),
        )
        .where((F.col("n_matched") >= F.greatest(F.lit(share) * F.col("n_windows"), least)) | (F.col("able") >= F.greatest(F.lit(share) * F.col("n_able"), least)))
        .drop("n_able", "able")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that no item contaminates."""
    keys = contaminated(docs, benchmark, share).select("key").distinct()
    return unboxed(boxed(docs, key=F.xxhash64("doc_id", "text")).join(keys, "key", "left_anti"))
