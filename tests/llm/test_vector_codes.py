"""Codes and codebooks against a plain computation."""

import hashlib
import math
import random

import pytest
from pyspark.sql import types as T

from shockweave.llm import vector_codes
from shockweave.llm.tables import importable

SCHEMA = "vec_id long, embedding array<double>, label int, code string, key int, x string"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def brute(rows):
    def good(v):
        return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)

    ints = lambda v: [math.floor(max(-(2.0**26), min(2.0**26, 256 * c))) for c in v]
    kept = sorted(((r[0], ints(r[1]), r[2]) for r in rows if good(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    ends = [k * width // 16 for k in range(17)]
    part = lambda r, p: r[1][ends[p] : ends[p + 1]]
    books = [[part(r, p) for r in kept[:64]] for p in range(16)]

    def assigned(p):
        far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
        return [min((far(part(r, p), e), k) for k, e in enumerate(books[p])) for r in kept]

    for _ in range(2):
        for p in range(16):
            mine = [k for _, k in assigned(p)]
            for k in range(len(books[p])):
                members = [part(r, p) for r, m in zip(kept, mine) if m == k]
                if members:
                    books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    codes = list(zip(*[assigned(p) for p in range(16)]))
    errors = [sum(d for d, _ in c) for c in codes]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [
        (r[0], "".join(f"{k:02x}" for _, k in c), e, by_label[r[2]], digest) for r, c, e in zip(kept, codes, errors)
    ]


def compare(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1, "x") for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in vector_codes.vector_codes(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def some_rows(n=400, width=32, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = [rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1), 1)]) for _ in range(width)]
        rows.append([k * 3 % n, v, rng.choice([0, 1, 2, None])])
    for k in range(150):  # a common vector
        rows.append([1000 + k, rows[5][1], 1])
    nan, inf = float("nan"), float("inf")
    rows += [[7, None, 1], [8, [], 1], [9, [None] * width, 1], [10, [nan] + [0.0] * (width - 1), 1], [11, [inf] * width, 1]]
    rows += [rows[3], rows[3], [None, rows[4][1], None], [5, [1.0] * 3, 2], [2000, [1e30, -1e30] + [0.5] * (width - 2), 3]]
    return rows


@pytest.mark.parametrize("width", [32, 16, 21, 5])
def test_equals_brute_force(spark, width):
    compare(spark, some_rows(width=width, seed=width))


def test_many_salts(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "OWNER_ROWS", 16)
    compare(spark, some_rows(seed=3))


def test_fewer_rows_than_entries(spark):
    assert len(compare(spark, some_rows(20, seed=4)[:20])) == 20
    assert compare(spark, [[1, None, 1], [2, [], 0]]) == []


def test_integer_distances_beyond_doubles():
    import numpy as np

    big = 1 << 26
    x = np.array([[big, -big, 1], [0, 1, 2]])
    book = np.array([[big, -big, 3], [big, -big, 2], [0, 1, 1], [0, 1, 3]])
    index, error = vector_codes.nearest(x, book)
    assert index.tolist() == [1, 2] and error.tolist() == [1, 1]


def test_only_movers_are_shuffled(spark):
    rows = some_rows(seed=5)
    df = spark.createDataFrame([(k, r[0], [int(256 * c) for c in r[1]]) for k, r in enumerate(rows[:400])], "key long, vec_id long, x array<int>")
    import numpy as np

    seeds = np.array([r.x for r in df.orderBy("vec_id").limit(64).collect()])
    books = [seeds[:, 2 * p : 2 * p + 2] for p in range(16)]
    written = []
    original = vector_codes.with_owners
    try:
        vector_codes.with_owners = lambda parts, salts: written.append(original(parts, salts)) or written[-1]
        coded, _ = vector_codes.lloyd(df, 32, books, 3)
        assert coded.count() == 400 * 16
    finally:
        vector_codes.with_owners = original
    first, moved = (t.count() for t in written)
    assert first == 400 * 16 and 0 < moved < first
    at = written[1].alias("b").join(written[0].alias("a"), ["key", "position"])
    assert at.where("a.entry = b.entry").count() == 0


def test_schema(spark):
    empty = spark.createDataFrame([], SCHEMA)
    got = vector_codes.vector_codes(empty)
    assert got.collect() == [] and [f.dataType for f in got.schema] == [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
