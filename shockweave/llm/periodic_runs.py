"""Stretches of words that repeat with one period four times or more, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words
that no neighbouring word extends keeping q. If 2^k <= q < 2^(k+1), the block of 2^k words
that starts at the first multiple of 2^k in the run occurs again q words later. So for every
level k each block that is repeated at all asks where it occurs in the window of 2^k places
behind it. Occurrences of a block in a window that short form one arithmetic progression:
the first and second and their number tell all of them, found by range successor in a
wavelet tree over the suffix array, in which the occurrences of a block are one range.

One or two occurrences are candidate periods as they are. Three or more mean that the block
has a small period d itself; then the stretch of period d around the block and the one
around its occurrences must end, or begin, one period apart, which leaves two candidates.
Each candidate is extended to both sides by longest common extensions, and of candidates
with one stretch the smallest is its period. All candidates are checked exactly, so
results are exact.

Ranks of the 2^k words from each place (prefix doubling) give the suffix array, ranges and
extensions. Many documents share one array, parted by symbols that occur once. Words are
equal if their bytes are: hashes number them, the bytes check it.

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed
text; repeated rows and ties give equal results; a table without rows gives none; other
columns are kept in ``row`` and cannot clash. A text is treated whole, in memory for it that
grows with its words times their logarithm. No row is moved, so no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockweave.llm.bpe import ranges
from shockweave.llm.hashing import SPACE, joined, runs, span_hashes
from shockweave.llm.tables import boxed, slices, texts_of

#: A run has so many words at least, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
SLICE = 1 << 20
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(RUN)),
    T.StructField("collapsed", T.StringType()),
]


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span; equal numbers if and only if the bytes are equal."""
    _, first, ids = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    same, sizes = first[ids], ends - starts
    if np.array_equal(sizes[same], sizes) and np.array_equal(data[ranges(starts[same], sizes)], data[ranges(starts, sizes)]):
        return ids
    raw, known = data.tobytes(), {}
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())])


class Ranks:
    """``levels[k][i]``: where in the suffix array the places begin that share 2^k symbols with place ``i``."""

    def __init__(self, symbols: np.ndarray, levels: int):
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        in_order = symbols[self.order]
        begin = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1]))
        rank = np.empty(n, np.int64)
        rank[self.order] = np.repeat(begin, np.diff(np.append(begin, n)))
        self.levels, self.sizes = [rank], [np.bincount(rank, minlength=n).astype(np.int32)]
        for k in range(levels):
            slots = np.flatnonzero(self.sizes[k][rank[self.order]] > 1)
            if not len(slots):
                break
            places = self.order[slots]
            key = rank[places] * n + rank[np.minimum(places + (1 << k), n - 1)]
            by_key = np.argsort(key, kind="stable")
            places, key = places[by_key], key[by_key]
            self.order[slots] = places
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            rank = rank.copy()
            rank[places] = np.repeat(slots[begin], np.diff(np.append(begin, len(slots))))
            self.levels.append(rank)
            self.sizes.append(np.bincount(rank, minlength=n).astype(np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` and ``j`` on are equal; the two must differ."""
        i, j, begin = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            rank, open_ = self.levels[k], np.arange(len(i))
            while len(open_):
                open_ = open_[rank[i[open_]] == rank[j[open_]]]
                i[open_] += 1 << k
                j[open_] += 1 << k
                if k < len(self.levels) - 1:
                    break
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols right before ``i`` and ``j`` are equal; ``i < j``."""
        i, j, begin = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            rank, open_ = self.levels[k], np.arange(len(i))
            while len(open_):
                open_ = open_[i[open_] >= 1 << k]
                open_ = open_[rank[i[open_] - (1 << k)] == rank[j[open_] - (1 << k)]]
                i[open_] -= 1 << k
                j[open_] -= 1 << k
                if k < len(self.levels) - 1:
                    break
        return begin - i


class WaveletTree:
    """The values of a permutation, bit by bit from the top, stably parted into zeros and ones."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.total = [], []
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(zero))).astype(np.int32))
            self.total.append(int(self.zeros[-1][-1]))
            values = np.concatenate((values[zero], values[~zero]))

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values at places ``low .. high - 1`` are less than ``value``."""
        count = np.where(value >= 1 << self.bits, high - low, 0)
        for k in range(self.bits):
            zl, zh = self.zeros[k][low], self.zeros[k][high]
            one = (value >> (self.bits - 1 - k)) & 1 == 1
            count += np.where(one & (value < 1 << self.bits), zh - zl, 0)
            low, high = np.where(one, self.total[k] + low - zl, zl), np.where(one, self.total[k] + high - zh, zh)
        return count

    def at(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of that rank among those at places ``low .. high - 1``."""
        value = np.zeros(len(low), np.int64)
        for k in range(self.bits):
            zl, zh = self.zeros[k][low], self.zeros[k][high]
            one = rank >= zh - zl
            rank = np.where(one, rank - (zh - zl), rank)
            value = value << 1 | one
            low, high = np.where(one, self.total[k] + low - zl, zl), np.where(one, self.total[k] + high - zh, zh)
        return value


def candidates(ranks: Ranks, tree: WaveletTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of blocks of 2^k symbols and candidate periods from 2^k to 2^(k+1) - 1."""
    size, rank = 1 << k, ranks.levels[k]
    blocks = np.arange(0, len(rank), size)
    blocks = blocks[ranks.sizes[k][rank[blocks]] > 1]
    low = rank[blocks]
    high = low + ranks.sizes[k][low]
    before = tree.below(low, high, blocks + size)
    count = tree.below(low, high, blocks + 2 * size) - before
    hit = np.flatnonzero(count)
    blocks, low, high, before, count = (x[hit] for x in (blocks, low, high, before, count))
    first = tree.at(low, high, before)
    two = np.flatnonzero(count > 1)
    second = first.copy()
    second[two] = tree.at(low[two], high[two], before[two] + 1)
    some, pair = count < 3, count == 2
    places = [blocks[some], blocks[pair]]
    periods = [(first - blocks)[some], (second - blocks)[pair]]
    many = np.flatnonzero(~some)
    if len(many):
        b, f, d = blocks[many], first[many], (second - first)[many]
        left, right = b - ranks.backward(b, b + d), b + d + ranks.forward(b, b + d)
        left2, right2 = f - ranks.backward(f, f + d), f + d + ranks.forward(f, f + d)
        for period in (right2 - right, left2 - left):
            fits = (left2 != left) & (period >= size) & (period < 2 * size)
            places.append(b[fits])
            periods.append(period[fits])
    return np.concatenate(places), np.concatenate(periods)


def find_runs(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period.

    ``symbols`` are small integers; the last, and one between any two documents, occur once.
    ``longest`` is the number of words of the longest document.
    """
    if longest < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    ranks = Ranks(symbols, max(1, (longest // LEAST_TIMES).bit_length() - 1))
    tree = WaveletTree(ranks.order)
    found = [np.zeros((0, 3), np.int64)]
    for k in range(len(ranks.levels)):
        block, period = candidates(ranks, tree, k)
        end = block + period + ranks.forward(block, block + period)
        start = block - ranks.backward(block, block + period)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
        found.append(np.stack([start[long], end[long], period[long]], 1))
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)]]  # one stretch: its smallest
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def of_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of words; runs (start, length, period) of all texts and where each text's begin;
    bytes of all collapsed texts and where each begins."""
    data, offsets = joined(texts)
    starts, ends = runs(~SPACE[data])
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    if not len(starts):
        return n_words, np.zeros((0, 3), np.int64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ids = word_ids(data, starts, ends)
    # A symbol of its own behind every text.
    text = np.repeat(np.arange(len(texts)), n_words)
    symbols = np.arange(len(ids) + len(texts)) + len(ids)
    place = np.arange(len(ids)) + text
    symbols[place] = ids
    found = find_runs(symbols, int(n_words.max()))
    # Words that repeat: those of a run behind its first period.
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    kept = np.cumsum(change)[place] == 0
    sizes, text = (ends - starts)[kept], text[kept]
    gap = np.append(False, text[1:] == text[:-1])[: len(text)].astype(np.int64)
    upto = np.cumsum(sizes + gap)
    out = np.full(upto[-1] if len(upto) else 0, 0x20, np.uint8)
    out[ranges(upto - sizes, sizes)] = data[ranges(starts[kept], sizes)]
    text_at = np.append(0, upto)[np.searchsorted(text, np.arange(len(texts) + 1))]
    # Back from the shared array to words of each text.
    base = first[:-1] + np.arange(len(texts))
    owner = np.searchsorted(base, found[:, 0], "right") - 1
    rows = np.stack([found[:, 0] - base[owner], found[:, 1] - found[:, 0], found[:, 2]], 1)
    return n_words, rows, np.searchsorted(owner, np.arange(len(texts) + 1)), out, text_at


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        n_words, rows, row_at, out, text_at = of_texts(texts_of(batch.column("text")))
        structs = pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], [f.name for f in RUN])
        lists = pa.ListArray.from_arrays(pa.array(row_at, pa.int32()), structs)
        texts = pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer(text_at.astype(np.int64)), pa.py_buffer(out))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(n_words.astype(np.int64)), lists, texts.cast(pa.string())],
            ["row", *[f.name for f in RESULT]],
        )


def periodic_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, all if None), ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are (start, length, period) in words by start, then period; ``collapsed`` is the
    text of the words that do not repeat, joined by one space.
    """
    rows = boxed(docs, keep, text=F.col("text").cast("string"))
    return rows.mapInArrow(_scanned, T.StructType([rows.schema["row"], *RESULT]))


def strongest(runs_: str) -> Column:
    """The run with the greatest length / period, exactly; of equal ones the first. Null without runs."""
    none = F.lit(None).cast(RUN)

    def better(best: Column, r: Column) -> Column:
        greater = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | greater, r).otherwise(best)

    return F.aggregate(runs_, none, better)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth document, by a hash of its doc_id, made periodic from some word on."""
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h, n = F.crc32(F.col("doc_id").cast("string")), F.size(words)
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # The lambda of a transform would cut the text anew for every word; whole slices do not.
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    cycles = F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(cycles, F.lit(1), (n - a).cast("int"))), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text").cast("string")))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document: how many runs, the strongest, digests of all runs and of the collapsed text."""
    best = strongest("runs")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return periodic_runs(docs, ["doc_id"]).select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
