"""Runs of periodic words against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import cases
from shockweave.llm import periodic_runs
from shockweave.llm.tables import importable


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def brute(w):
    codes = np.unique(w, return_inverse=True)[1] if w else np.zeros(0, int)
    found = {}
    for q in range(1, len(w) // 4 + 1):
        equal = np.concatenate(([False], codes[:-q] == codes[q:], [False]))
        edges = np.flatnonzero(equal[1:] != equal[:-1]).tolist()
        for i, j in zip(edges[::2], edges[1::2]):
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in dropped)


def periodic_words(rng):
    n, k = rng.randint(0, rng.choice([5, 40, 150, 400])), rng.choice([1, 2, 3, 50])
    w = [str(rng.randrange(k)) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        q, a = rng.randint(1, max(1, n // 5)), rng.randrange(n + 1)
        for i in range(a + q, min(n, a + q * rng.randint(3, 8))):
            w[i] = w[i - q]
    return w


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


SPECIAL = [fibonacci(400), list("aabaab" * 20 + "aab" + "b" * 30 + "aabaab" * 9), (["x"] * 40 + ["y"]) * 9, ["x"] * 500, []]


@pytest.mark.parametrize("seed", range(12))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    docs = [periodic_words(rng) for _ in range(rng.randint(1, 40))] + SPECIAL
    docs += docs[:5]
    n_words, rows, at, out, text_at = periodic_runs.of_texts([" ".join(w).encode() for w in docs])
    for k, w in enumerate(docs):
        expected = brute(w)
        assert n_words[k] == len(w)
        assert [tuple(r) for r in rows[at[k] : at[k + 1]].tolist()] == expected
        assert out[text_at[k] : text_at[k + 1]].tobytes().decode() == collapsed(w, expected)


def test_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(periodic_runs, "span_hashes", lambda data, starts, ends: (ends - starts).astype("uint64"))
    w = "aa bb".split() * 4 + "cc dd".split() * 4
    _, rows, *_ = periodic_runs.of_texts([" ".join(w).encode()])
    assert rows.tolist() == [[0, 8, 2], [8, 8, 2]]


def test_query_digests(spark):
    rng = random.Random(5)
    data = cases.rows() + [(2000 + k, "\v".join(periodic_words(rng)), "en", "s", 0) for k in range(60)]
    data += [(3000 + k, " ".join(cases.words(rng, 40)), "en", "s", 0) for k in range(60)]
    docs = cases.docs(spark, data=data, extra=True)
    got = periodic_runs.run_digests(periodic_runs.with_planted_runs(docs)).collect()
    expected = []
    for doc_id, text, *_ in data:
        w = [x.decode() for x in (text or "").encode().split()]
        n = len(w)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w)
        best = None
        for r in found:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        values = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        expected.append((doc_id, len(found), *values, digest(lines), digest(collapsed(w, found))))
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + r[-2:]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert sum(r[1] > 0 for r in expected) > 20


def test_empty_and_kept_columns(spark):
    empty = cases.docs(spark, data=[])
    assert periodic_runs.run_digests(periodic_runs.with_planted_runs(empty)).collect() == []
    docs = cases.docs(spark, extra=True).selectExpr("*", "'y' as runs", "'z' as row")
    rows = periodic_runs.periodic_runs(docs)
    assert rows.select("row.*").columns == docs.columns
    assert rows.where("row.runs = 'y' and collapsed is not null").count() == docs.count()
