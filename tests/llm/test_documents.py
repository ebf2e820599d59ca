"""Operators over documents against brute force on small tables."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import cases
from shockweave.llm import decontaminate, jaccard_join, kd_sharding, mixing, quality, secrets, token_output
from shockweave.llm.tables import importable

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(data):
    sets, n = [shingles(r[1]) for r in data], len(data)
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(n):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(data[i][0])
    return [
        (data[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(n)
    ]


none_last = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("short", [1, 16])
def test_jaccard_components(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard_join, "SHORT", short)  # both ways of treating a list
    got = [tuple(r) for r in jaccard_join.jaccard_join(cases.docs(spark, extra=True)).collect()]
    assert none_last(got) == none_last(brute_components(cases.rows()))


def test_jaccard_ids_missing_or_shared(spark):
    rng = random.Random(12)
    data = []
    for k in range(12):
        w = cases.words(rng, 60)
        left, middle, right = " ".join(["x1", *w]), " ".join(w), " ".join([*w, "x2"])
        # Links through rows without id, and an id that stands for several texts.
        data += [(10 * k, left, "en", "s", 0), (None, middle, "en", "s", 0), (10 * k + 1, right, "en", "s", 0), (7, left + " x3", "en", "s", 0)]
    got = [tuple(r) for r in jaccard_join.jaccard_join(cases.docs(spark, data=data)).collect()]
    assert none_last(got) == none_last(brute_components(data))


def test_jaccard_keeps_one(spark):
    got = jaccard_join.one_of_each(cases.docs(spark, extra=True))
    expected = {d for d, _, c in brute_components(cases.rows()) if d == c and d is not None}
    ids = [r.doc_id for r in got.collect()]
    assert sorted(ids) == sorted(expected) and got.columns == cases.docs(spark, extra=True).columns


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_join(cases.docs(spark, data=[])).collect() == []


def test_token_files(spark):
    manifest = token_output.write_ids(cases.docs(spark, extra=True), WORD_BPE)
    got = token_output.read_digests(manifest).orderBy("start").collect()
    tokenizer, start = Tokenizer.from_file(WORD_BPE), 0
    data = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for row, (doc_id, text, *_) in zip(got, data, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), crc)
        start += len(ids)
    first = manifest.orderBy("shard").first()
    shard = token_output.Shard(first.path)
    assert len(shard.index) == first.documents
    assert shard.ids(len(shard.index) - 1) == list(shard.blocks(1))[-1][1][-1]
    assert token_output.read_digests(token_output.write_ids(cases.docs(spark, data=[]), WORD_BPE)).collect() == []


def test_secrets_base_and_learned(spark):
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    data = [(i, f'é is token = "{hexes(40)}" and mail{i}.example.com 10.0.0.{i}', "en", "s", 0) for i in range(300)]
    data += [(300, f"PASSWORD: '{'A1b2' * 5}' api_key=short AKIA{'Z9' * 9} pwd", "en", "s", 0)]
    data += [(301, "ghp_" + "aB3" * 9, "en", "s", 0)]
    data += [(302, "\u017fecret=abcdefghijklmnop to\u212aen=abcdefghijklmnop", "en", "s", 0)] + cases.rows()
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    )
    got = {(r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.scan(cases.docs(spark, data=data)).collect()}
    expected = set()
    for doc_id, text, *_ in data:
        t = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        expected.add((doc_id, hashlib.sha256(line.encode()).hexdigest(), *[sum(s[1] == k for s in spans) for k in range(3)]))
    assert got == expected
    assert secrets.scan(cases.docs(spark, data=[])).collect() == []


def test_secret_network_keeps_recall(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    data = [(i, f"secret={key()} at mail{i}.example.com and 192.168.10.{i % 256}", "en", "s", 0) for i in range(400)]
    net = secrets.train(cases.docs(spark, data=data))
    tokens = [key().encode() for _ in range(50)]
    hosts = [f"mail{i}.example.com".encode() for i in range(900, 950)]
    scores = net.scores(secrets.coded([secrets.window(t, 0, len(t)) for t in tokens + hosts]))
    assert (scores[:50] >= net.threshold).mean() >= 0.9 and (scores[50:] < net.threshold).mean() >= 0.9


def test_mixing_hits_targets_and_repeats(spark):
    rng = random.Random(2)
    data = [(i, " ".join(cases.words(rng, rng.randint(0, 60))), "en", f"s{i % 5}" if i % 11 else None, 0) for i in range(3000)]
    data += cases.rows()[:50] + [(9000, "a b", "en", "tiny", 0)]
    got = mixing.mix(cases.docs(spark, extra=True, data=data), keep=["doc_id", "source", "text", "key"]).collect()
    assert len(got) == len(data)
    sizes = {}
    for r in got:
        assert r.size == len((r.row.text or "").encode().split()) and 0 <= r.copies <= 3
        s = sizes.setdefault(r.row.source, [0, r.target, 0])
        s[0] += r.size
        s[2] += r.size * r.copies
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, open_ = sum(s[0] for s in sizes.values()), dict(weights)
    target = {}
    while True:
        level = (total - sum(target.values())) / sum(open_.values())
        full = [s for s in open_ if level * open_[s] >= 3 * sizes[s][0]]
        if not full:
            break
        target |= {s: 3 * sizes[s][0] for s in full}
        open_ = {s: w for s, w in open_.items() if s not in full}
    target |= {s: level * w for s, w in open_.items()}
    for s, (_, t, taken) in sizes.items():
        assert t == pytest.approx(target[s]) and abs(taken - t) <= 200
    again = mixing.mix(cases.docs(spark, data=data), keep=["doc_id", "text"]).collect()
    assert sorted((r.row.doc_id or -1, r.copies) for r in again) == sorted((r.row.doc_id or -1, r.copies) for r in got)
    assert mixing.mixed_documents(cases.docs(spark, data=[])).collect() == []
    mixed = mixing.mixed_documents(cases.docs(spark, extra=True, data=data))
    assert mixed.columns == cases.docs(spark, extra=True).columns and mixed.count() == sum(r.copies for r in got)


def test_transfer_keeps_words():
    rng = random.Random(4)
    for _ in range(2000):
        p, q, s, t = rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99), rng.randint(1, 500), rng.randint(1, 500)
        a, b = mixing.transfer(p, s, q, t, rng.random())
        assert a * s + b * t == pytest.approx(p * s + q * t)
        assert (a in (0, 1) or b in (0, 1)) and 0 <= a <= 1 and 0 <= b <= 1


ITEMS = [
    (1, "A train leaves the old station at 5 km and meets Anna after 12 minutes of steady travel near the wide river"),
    (2, "How many ripe apples does Tom carry home when every basket holds 7 apples and 7 more fall from the tree"),
    (3, "too short"),
    (4, None),
]


def test_decontamination(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as key")
    other = ITEMS[0][1].replace("5", "41").replace("12", "3.5").replace("Anna", "Peter")
    mixed_up = ITEMS[1][1].replace("7 apples", "8 apples")  # equal numbers become different ones
    data = cases.rows() + [
        (2000, "before it. " + ITEMS[0][1] + ". after", "en", "s", 0), (2001, "see: " + other, "en", "s", 0),
        (2002, ITEMS[1][1].upper(), "en", "s", 0), (2003, mixed_up, "en", "s", 0), (2004, "too short", "en", "s", 0),
        (None, ITEMS[0][1], "en", "s", 0), (2000, "before it. " + ITEMS[0][1] + ". after", "en", "s", 0),
    ]
    docs = cases.docs(spark, extra=True, data=data)
    got = {(r.doc_id, r.item_id, r.n_changed) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got >= {(2000, 1, 0), (None, 1, 0), (2001, 1, 3)}
    assert {r[0] for r in got} <= {2000, 2001, 2002, None}
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len(data) - sum(r[0] in (2000, 2001) or (r[0] is None and r[1] == ITEMS[0][1]) for r in data) - (2002 in {r[0] for r in got})
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(cases.docs(spark, data=[]), bench).collect() == []


def test_quality_on_held_out_rows(spark):
    rng = random.Random(6)
    data, labels = [], []
    for i in range(600):
        w = cases.words(rng, rng.randint(5, 150))
        good = i % 3 != 0
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        if not good and i % 2:  # a bad passage in a good text
            text = " ".join(cases.words(rng, 100)) + " " + text
        data.append((i, text, "en", "s", 0))
        labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (5, None, 0), (7, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = cases.docs(spark, extra=True, data=data + cases.rows()[-12:])
    got = quality.quality_scores(docs, frame).collect()
    assert len(got) == len(data) + 12 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in held) / len(held) > 0.95
    assert quality.good_documents(docs, frame).columns == docs.columns
    assert {r.score for r in quality.quality_scores(docs, frame.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(cases.docs(spark, data=[]), frame).collect() == []


def test_kd_shards(spark):
    rng = random.Random(8)
    data = [(10_000 + i, " ".join(cases.words(rng, rng.randint(1, 80))), rng.choice(["en", "fr", None]), f"s{rng.randint(0, 9)}", 0) for i in range(4000)]
    data += [(5000 + i, "the same text", "en", "s0", 0) for i in range(2000)] + cases.rows()[:40] + cases.rows()[-4:-2] + [(9000, None, None, None, None)]
    got = kd_sharding.kd_shards(cases.docs(spark, extra=True, data=data)).collect()
    assert len(got) == len(data) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    text = {r[0]: r[1] for r in data}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1 if text[r.doc_id] is not None else 1, zlib.crc32(raw))
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(8))
    loads = [sum(r.size for r in s) for s in shards.values()]
    assert max(loads) <= 1.05 * min(loads)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    assert len({r.shard for r in got if text[r.doc_id] == "the same text"}) == 1
    assert kd_sharding.kd_shards(cases.docs(spark, data=[])).collect() == []


def test_secret_candidates_are_all_runs():
    rng = random.Random(14)
    letters = "".join(rng.choice("abcdefXYZ") for _ in range(200))
    texts = [b"", "é key Qwertz ab7 \0 z".encode(), f"is {letters} or {letters[:45]} or {letters[:44]}é.".encode(), b"aB", b"secret=abcdefghijkl x"]
    data, starts = secrets.padded(texts)
    base, a, b = secrets.findings(texts, data, starts)
    runs = {bytes(data[x:y]) for x, y in zip(a, b)}
    assert runs >= {b"key", b"Qwertz", b"ab7", b"z", letters.encode(), b"aB", b"x"} and b"secret=abcdefghijkl" not in runs
    assert [len(s) for s in base] == [0, 0, 0, 0, 1]
    x, y, first = secrets.pieces(a, b)
    covered = {(int(p), k) for p, q in zip(x, y) for k in range(p, q)}
    assert {k for _, k in covered} == {k for p, q in zip(a, b) for k in range(p, q)} and max(y - x) <= secrets.BODY and len(first) == len(a)
    net = secrets.Network()
    rows = secrets.windows_at(data, x, y)
    whole = net.scores(secrets.coded([r.tobytes() for r in rows]))
    assert net.scores_at(data, x, y) == pytest.approx(whole, abs=1e-5)
    plain = secrets.window(texts[1], 3, 6)
    assert plain in {r.tobytes() for r in rows}


def test_secret_threshold_keeps_recall_below_half():
    net = secrets.Network()
    x = secrets.coded([secrets.window(b"same", 0, 4)] * 100)
    y = [1.0] * 10 + [0.0] * 90
    net.calibrate(x, secrets.np.array(y))
    assert net.threshold < 0.5 and (net.scores(x)[:10] >= net.threshold).mean() >= secrets.RECALL


def test_decontamination_whatever_the_case(spark):
    many = "Anna and Bob visit Carla with Dave while Emma paints the house of Frank near Grand Lake before Hugo and Iris come home"
    opening = "Peter buys 4 ripe pears at the old market. Anna eats two of the pears there. Peter sells all other pears before noon."
    long = "the price of the 7 small red boats rises every year until " + " ".join(f"w{chr(97 + k)}x" for k in range(20)) + " and the 7 large ones stay"
    bench = spark.createDataFrame([(1, many), (2, opening), (3, long)], "item_id long, text string")
    again = opening.replace("Peter", "Karl").replace("Anna", "Rosa").replace("4", "9")
    head, tail = long.rsplit("7", 1)
    data = [
        (1, many.upper(), "en", "s", 0), (2, many.title(), "en", "s", 0), (3, many.lower(), "en", "s", 0), (4, again, "en", "s", 0),
        (5, opening.upper().replace("4", "9"), "en", "s", 0), (6, f"{head}8{tail}", "en", "s", 0), (7, "see " + many.replace("Anna", "Zoe"), "en", "s", 0),
    ]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(cases.docs(spark, data=data), bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 1)}


def test_jaccard_one_of_each_row(spark):
    rng = random.Random(15)
    w, v = cases.words(rng, 60), cases.words(rng, 60)
    near, other = " ".join([*w, "x1"]), " ".join(cases.words(rng, 50))
    data = [
        (None, "", "en", "s", 0), (None, None, "en", "s", 0),  # a blank text without id must not keep the others
        (5, " ".join(w), "en", "s", 0), (None, near, "en", "s", 0), (None, " ".join(v), "en", "s", 0),
        (None, " ".join([*v, "x2"]), "en", "s", 0), (6, near, "en", "s", 0), (6, other, "en", "s", 0), (6, other, "en", "s", 1),
    ]
    got = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(cases.docs(spark, data=data)).collect()]
    lone = [t for i, t in got if i is None and t]
    assert sorted(t for i, t in got if i is not None) == sorted([" ".join(w), other])
    assert len(lone) == 1 and lone[0].startswith(" ".join(v)) and sum(i is None and not t for i, t in got) == 2


def test_quality_draws_labels_of_given_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_DOCS", 40)
    rng = random.Random(16)
    data = [(i, " ".join(w if i % 2 else w.upper() + "!!" for w in cases.words(rng, 50)), "en", "s", 0) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6000)], "doc_id long, quality int")
    assert isinstance(quality.train(cases.docs(spark, data=data), labels), quality.Model)
