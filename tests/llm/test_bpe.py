"""Encoding and decoding against the tokenizers library."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import cases
from shockweave.llm import bpe
from shockweave.llm.tables import importable

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", "A", "Σ", "ΑΣ", "İ", "ß", "'s", "'", "é", "́", "̸", ">", "<|endoftext|>",
    "<|startoftext|>", "<|", "1", "²", "٣", " ", "\t", "\x0b", "\x1c", "\x85", " ", " ", "　", "​",
    "日本", "한", "\U0001f600", "'RE", "n't", "_", "$$$", "\x00", "ǅ", "ﬁ", "K", "﻿", "aaaa", "th",
]


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def odd_texts(n=1500, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*texts, "a" * 3000, "ab" * 2000, "".join(rng.choice("abcdefghij") for _ in range(20_000))]


def compare(encoder, texts):
    library = Tokenizer.from_file(WORD_BPE)
    ids, starts = encoder([t.encode() for t in texts])
    decoded = bpe.decoded_texts(encoder.vocabulary, ids, starts).to_pylist()
    for k, text in enumerate(texts):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids[starts[k] : starts[k + 1]].tolist() == wanted
        assert decoded[k] == library.decode(wanted, skip_special_tokens=False)


def test_equals_library():
    compare(bpe.Encoder(WORD_BPE), odd_texts())


def test_forgets_and_meets_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    encoder, texts = bpe.Encoder(WORD_BPE), odd_texts(400, 2)
    for k in range(0, len(texts), 20):
        compare(encoder, texts[k : k + 20])
    compare(encoder, texts[:100])


def test_one_pair_a_round(monkeypatch):
    encoder = bpe.Encoder(WORD_BPE)
    encoder.vocabulary.together = False
    compare(encoder, odd_texts(200, 3)[:201])


def test_pieces_of_one_hash(monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: (ends - starts).astype("uint64"))
    compare(bpe.Encoder(WORD_BPE), odd_texts(100, 4)[:100])


def test_refuses_other_tokenizers(tmp_path):
    spec = json.load(open(WORD_BPE, encoding="utf-8"))
    spec["normalizer"] = {"type": "NFKC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="normalizer"):
        bpe.Vocabulary(str(other))


def test_digests(spark):
    library = Tokenizer.from_file(WORD_BPE)
    got = bpe.round_trip_digests(cases.docs(spark, extra=True), WORD_BPE).collect()
    expected = []
    for doc_id, text, *_ in cases.rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert bpe.round_trip_digests(cases.docs(spark, data=[]), WORD_BPE).collect() == []


def test_columns_kept_and_odd_ids(spark):
    docs = cases.docs(spark, extra=True).selectExpr("*", "'y' as ids", "'z' as row", "'d' as decoded")
    rows = bpe.encode(docs, WORD_BPE)
    assert rows.select("row.*").columns == docs.columns
    assert rows.where("row.ids = 'y' and row.row = 'z'").count() == docs.count()
    odd = spark.createDataFrame([(1, None), (2, []), (3, [5, None, -1, 10**6, 7])], "k int, ids array<int>")
    library = Tokenizer.from_file(WORD_BPE)
    got = {r.k: r.decoded for r in bpe.decode(odd, WORD_BPE).collect()}
    assert got == {1: "", 2: "", 3: library.decode([5, 7], skip_special_tokens=False)}
