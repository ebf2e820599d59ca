"""WARC round trip, boilerplate lines and near vectors against brute force."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import pytest

from shockweave.llm import line_dedup, near_vectors, warc
from shockweave.llm.tables import importable


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "'x' as line", "1 as size").repartition(4)


def page_rows():
    rng, out = random.Random(1), []
    for i in range(120):
        host = "a.example" if i % 3 else f"b{i % 4}.example"
        body = "".join(f"<p>line <b>{rng.randint(0, 400)}</b></p>" for _ in range(rng.randint(0, 6)))
        out.append((i, f"https://{host}/{i}?x=1", f"<html><nav>Home</nav><script>var x='<p>';</script>{body}<br>end \n here</html>"))
    out += [(200, None, "<p>Home</p>"), (201, "no host", "<p>Home</p>"), (202, "http://A.example", None), (203, "http://a.example/\r\n b", "")]
    out += [out[0], out[5], (None, "http://a.example/", out[7][2]), (204, "http://user@a.example:80/", out[7][2]), (205, "x://y", "é" * 200_000)]
    return out


def test_warc_round_trip(spark):
    data = page_rows()
    manifest = warc.write_warc(pages(spark, data), shard_bytes=20_000, roll_bytes=2_000)
    got = sorted((tuple(r) for r in warc.read_warc(manifest).collect()), key=str)
    first = {}
    for i, _, h in data:
        first[h or ""] = min((x for x in (i, first.get(h or "")) if x is not None), default=None)
    expected = []
    for i, _, h in data:
        raw, revisit = (h or "").encode(), first[h or ""] != i
        sha1 = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        expected.append((i, len(raw), sha1, "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert got == sorted(expected, key=str)
    files = {r.path.rpartition("/")[2]: r for r in manifest.collect()}
    assert len(files) > 3 and sum(r.records for r in files.values()) == len(data)
    again = warc.write_warc(pages(spark, data).repartition(7), shard_bytes=20_000, roll_bytes=2_000)
    read = lambda r: warc.opened(r.path)[0].open_input_file(warc.opened(r.path)[1]).read()
    assert {r.path.rpartition("/")[2]: read(r) for r in again.collect()} == {k: read(r) for k, r in files.items()}
    assert warc.read_warc(warc.write_warc(pages(spark, []))).collect() == []


def test_boilerplate_lines(spark):
    data = page_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", data)
    expected = sorted(con.execute(line_dedup.ORACLE).fetchall(), key=str)
    got = sorted((tuple(r) for r in line_dedup.drop_boilerplate(pages(spark, data)).collect()), key=str)
    assert got == expected and sum(r[3] for r in got) > 100
    assert {r[0]: r[4] for r in got}[200] == "Home"
    assert line_dedup.drop_boilerplate(pages(spark, [])).collect() == []


@pytest.mark.parametrize("block", [4, 2048])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rng, data = np.random.default_rng(3), []
    centre = rng.normal(size=(6, 24))
    for i in range(240):
        v = centre[i % 6] + rng.normal(size=24) * 0.12 if i % 2 else rng.normal(size=24)
        data.append((i, [float(x) for x in np.float32(v)], i % 3))
    data += [(i + 300, data[1][1], data[1][2]) for i in range(5)] + [(400, None, 1), (401, [], 1), (402, [0.0] * 24, 1), (403, data[1][1], None)]
    data += [(404, [float("nan")] * 24, 1), (405, [None] + [1.0] * 23, 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (None, data[1][1], data[1][2])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as node", "2 as weight")
    got = {}
    for r in near_vectors.near_vectors(frame).collect():
        got.setdefault(r.vec_id, (r.n_links, r.component_id, r.kept))
    n, near = len(data), np.zeros((len(data), len(data)), bool)
    for a in range(n):
        for b in range(a):
            (_, x, p), (_, y, q) = data[a], data[b]
            if x and y and p is not None and p == q and len(x) == len(y) and None not in x and None not in y:
                x, y = np.float64(x), np.float64(y)
                size = np.linalg.norm(x) * np.linalg.norm(y)
                near[a, b] = near[b, a] = bool(np.isfinite(size) and size > 0 and x @ y / size >= 0.93)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None], n).min(1))
        if (new == label).all():
            break
        label = new
    smallest = {}
    for i in range(n):
        if data[i][0] is not None:
            smallest[label[i]] = min(smallest.get(label[i], 1 << 60), data[i][0])
    right = sum(got[data[i][0]][0] == near[i].sum() for i in range(n))
    assert right >= 0.95 * n and all(got[data[i][0]][0] <= near[i].sum() for i in range(n))
    alone = [i for i in range(n) if not near[i].any() and data[i][0] is not None]
    assert all(got[data[i][0]] == (0, data[i][0], True) for i in alone)
    same = sum(got[data[i][0]][1] == smallest[label[i]] for i in range(n))
    assert same >= 0.95 * n
    assert near_vectors.near_vectors(frame.limit(0)).collect() == []
