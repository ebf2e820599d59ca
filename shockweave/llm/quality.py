"""Quality classifier by attention over passages.

A document is a bag of passages of a fixed number of words, all of them. Each passage is a
vector of character and word figures, encoded by a layer of tanh units; a gated attention
network, learned from document labels alone, weighs the passages, and a logistic unit
scores the weighted sum.

Labels come from a bounded sample (TRAIN_DOCS documents, TRAIN_PASSAGES of each); scoring
streams all documents through tasks with the fitted weights, a few kilobytes.

Defined results: a null or empty text is one passage without characters and gets a score
like any other; with no labels, or of one kind only, the score is their smoothed share; a
null doc_id is not held out and has no label; a label row with null doc_id or quality is
left out, of several for a document the largest counts; of several rows of an id one is
learned from; repeated rows get equal scores;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockweave.llm.hashing import LOWER, SPACE, joined, runs, span_hashes
from shockweave.llm.tables import boxed, slices, texts_of, unboxed

PASSAGE_WORDS = 48
TRAIN_DOCS = 4000
TRAIN_PASSAGES = 64
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 24, 12, 40, 64, 0.01, 1e-4
THRESHOLD = 0.3

#: Classes of bytes, each counted as a share of a passage.
KINDS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"?",
    b"!", b"|", b"#$%&*", b"@/\\_=+<>^~`", b"'\"()[]{}-",
]
CLASS = np.full(256, len(KINDS), np.int64)
for _k, _chars in enumerate(KINDS):
    CLASS[list(_chars)] = _k
N_KINDS = len(KINDS) + 1
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
FEATURES = N_KINDS + 8


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of all texts, and where the passages of each text start."""
    data, offsets = joined(texts)
    starts, ends = runs(~SPACE[data])
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n_pass, out=begin[1:])
    total = int(begin[-1])
    out = np.zeros((total, FEATURES), np.float32)
    # Passages as ranges of bytes: from a passage's first word, or the text's start, to the next.
    of = np.repeat(np.arange(len(texts)), n_pass)
    k = np.arange(total) - begin[:-1][of]
    word = np.minimum(first[:-1][of] + k * PASSAGE_WORDS, max(len(starts) - 1, 0))
    where = np.where((k == 0) | (len(starts) == 0), offsets[:-1][of], starts[word] if len(starts) else 0)
    of_byte = np.repeat(np.arange(total), np.diff(np.append(where, len(data))))
    counts = np.bincount(of_byte * N_KINDS + CLASS[data], minlength=total * N_KINDS).reshape(total, N_KINDS)
    out[:, :N_KINDS] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    if len(starts):
        doc_of = np.repeat(np.arange(len(texts)), n_words)
        of_word = begin[:-1][doc_of] + (np.arange(len(starts)) - first[:-1][doc_of]) // PASSAGE_WORDS
        size, held = ends - starts, np.maximum(np.bincount(of_word, minlength=total), 1)
        mean = np.bincount(of_word, size, total) / held
        out[:, N_KINDS] = mean / 10
        out[:, N_KINDS + 1] = np.sqrt(np.maximum(np.bincount(of_word, size**2, total) / held - mean**2, 0)) / 10
        out[:, N_KINDS + 2] = np.bincount(of_word, UPPER[data[starts]], total) / held
        out[:, N_KINDS + 3] = np.bincount(of_word, size >= 24, total) / held
        # Words as (passage, hash), sorted: how many differ, and how often the most frequent one comes.
        hashes = span_hashes(LOWER[data], starts, ends)
        key = np.sort((of_word.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        owner, times = (key[at] >> np.uint64(32)).astype(np.int64), np.diff(np.append(at, len(key)))
        out[:, N_KINDS + 4] = np.bincount(owner, minlength=total) / held
        most = np.zeros(total)
        np.maximum.at(most, owner, times)
        out[:, N_KINDS + 5] = most / held
        out[:, N_KINDS + 6] = np.log1p(held) / 4
        out[:, N_KINDS + 7] = np.log1p(n_words[of]) / 10
    return out, begin[:-1]


class Model:
    """Gated attention network in float64; ``w`` holds its weights by name."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w

    @classmethod
    def fresh(cls, x: np.ndarray, seed: int = 7) -> "Model":
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        mean, scale = x.mean(0), x.std(0) + 1e-3
        return cls({
            "mean": mean, "scale": scale, "enc": g(FEATURES, HIDDEN), "enc0": np.zeros(HIDDEN), "v": g(HIDDEN, ATTENTION),
            "u": g(HIDDEN, ATTENTION), "att": g(ATTENTION), "out": g(HIDDEN), "out0": np.zeros(1),
        })

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        x = np.clip((x - w["mean"]) / w["scale"], -8, 8)
        h = np.tanh(x @ w["enc"] + w["enc0"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * s) @ w["att"]
        sizes = np.diff(np.append(begin, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), sizes))
        a = e / np.repeat(np.add.reduceat(e, begin), sizes)
        z = np.add.reduceat(a[:, None] * h, begin)
        p = 1 / (1 + np.exp(-(z @ w["out"] + w["out0"])))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": p, "sizes": sizes}

    def gradients(self, f: dict[str, np.ndarray], begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, d = self.w, (f["p"] - y) / len(y)
        of = np.repeat(np.arange(len(y)), f["sizes"])
        dz = d[:, None] * w["out"]
        dh = f["a"][:, None] * dz[of]
        da = (dz[of] * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, begin)[of])
        dg = de[:, None] * w["att"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh += dt @ w["v"].T + ds @ w["u"].T
        dx = dh * (1 - f["h"] ** 2)
        return {
            "enc": f["x"].T @ dx, "enc0": dx.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds,
            "att": (f["t"] * f["s"]).T @ de, "out": f["z"].T @ d, "out0": d.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> "Model":
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                x = np.concatenate([bags[k] for k in part])
                begin = np.cumsum([0] + [len(bags[k]) for k in part[:-1]])
                g, step = self.gradients(self.forward(x, begin), begin, y[part]), step + 1
                for k, d in g.items():
                    d = d + DECAY * self.w[k]
                    m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * d, 0.999 * v.get(k, 0) + 0.001 * d * d
                    rate = RATE * (1 - epoch / EPOCHS)
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x, begin = passages(texts)
        return self.forward(x, begin)["p"]


class Constant:
    """Stands in where there is nothing to learn from."""

    def __init__(self, p: float):
        self.p = p

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.p)


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x, begin = passages(texts_of(batch.column("text")))
        bags = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(x)]):
            chosen = np.unique(np.linspace(a, b - 1, min(b - a, TRAIN_PASSAGES)).astype(int))
            bags.append(x[chosen].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_hash"), pa.array(bags, pa.binary()), batch.column("_label")], ["h", "bag", "label"]
        )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | Constant:
    """A model from the TRAIN_DOCS labelled ones of ``docs`` with the smallest hashes that are not held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label"))
        .where(f"doc_id is not null and _label is not null and not {HELD_OUT}")
        .groupBy("doc_id").agg(F.max("_label").alias("_label"))
    )
    # Only labels of these documents, so that all that are drawn have a text.
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    sample = known.join(present, "doc_id", "left_semi").withColumn("_hash", F.xxhash64("doc_id")).orderBy("_hash").limit(TRAIN_DOCS)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(sample), "doc_id")  # TRAIN_DOCS rows at most
        .select("_hash", "text", "_label")
        .mapInArrow(_bags, "h long, bag binary, label int")
        .groupBy("h").agg(F.min("bag").alias("bag"), F.max("label").alias("label"))  # an id may have any number of rows
        .collect()
    )
    rows.sort(key=lambda r: (r.h, bytes(r.bag)))
    y = np.array([r.label for r in rows], float)
    if len(set(y)) < 2:
        return Constant((y.sum() + 1) / (len(y) + 2))
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES).astype(float) for r in rows]
    return Model.fresh(np.concatenate(bags)).fit(bags, y)


def score(docs: DataFrame, model: Model | Constant, keep: list[str] | None = None) -> DataFrame:
    """``row``, the columns of ``docs`` or those in ``keep``, and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            p = shared.value.scores(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p)], ["row", "score"])

    rows = boxed(docs, keep, text=F.col("text").cast("string"))
    return rows.mapInArrow(run, rows.select("row", F.lit(0.0).alias("score")).schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, labels)
    scored = score(docs, model, ["doc_id"])
    return scored.select("row.doc_id", "score").select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject."""
    return unboxed(score(docs, train(docs, labels)).where(F.col("score") >= THRESHOLD))
