"""BPE encoding and decoding of whole texts in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks every pair of neighbours up
by binary search among the sorted keys of the merge rules, takes the lowest rank of each
word and merges its pairs of that rank; words without a pair left leave the array. A word
takes as many rounds as it uses ranks, whatever the number of words.

Texts are cut at ASCII white space, which this kind of tokenizer drops and never joins
across. Equal pieces are found by hash, checked byte by byte, and encoded once; a worker
remembers at most ``REMEMBERED`` of them and then keeps those it met most often.

Tokenizer files: BPE with word ends over byte-level symbols, texts put to NFC and lower
case, words cut by a pattern, special tokens cut out first; anything else is refused by
name. Without a decoder, which these files lack, decoding joins the tokens' strings by a
space.

Defined results: a null or empty text, or one of white space only, has no ids and decodes to
an empty text; null ids decode likewise, ids that no token has are left out, as the library
does; repeated rows and ties give equal results; a table without rows gives none; other
columns are kept in ``row`` and cannot clash. No row is moved, so no key can be hot.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockweave.llm.hashing import SPACE, joined, runs, span_hashes
from shockweave.llm.tables import boxed, slices, texts_of

REMEMBERED = 1 << 19
#: So many bytes of text, or so many ids, are worked on at once; a longer text alone.
SLICE = 1 << 20
NONE = np.iinfo(np.int64).max
#: Fixed value: the characters that \s stands for in the tokenizer's pattern.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What a tokenizer file must say to be encoded here.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PRETOKENIZERS = ["Split", "ByteLevel"]


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of every range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Vocabulary:
    """Tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._check(spec)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left, right, made = (np.array([vocab[x] for x in c], np.int64) for c in zip(*[(a, b, a + b) for a, b in rules]))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # Pairs of one rank may merge together if what they make only meets later rules.
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(born, made, np.arange(len(made)))
        self.together = bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]"))
        strings = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            strings[i] = text.encode()
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.strings = np.frombuffer(b"".join(strings), np.uint8)

    @staticmethod
    def _check(spec: dict) -> None:
        model, norm, pre = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        problems = [
            name
            for name, wrong in {
                "model": model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"],
                "model options": any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "unk_token")),
                "normalizer": [n["type"] for n in norm.get("normalizers", ())] != NORMALIZERS,
                "pre_tokenizer": [p["type"] for p in pre.get("pretokenizers", ())] != PRETOKENIZERS,
                "decoder": spec["decoder"] is not None,
                "added_tokens": any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]),
            }.items()
            if wrong
        ]
        if problems:
            raise ValueError(f"tokenizer file differs in {', '.join(problems)} from what is encoded here")

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.inner[data], np.repeat(np.arange(len(words)), sizes)
        last = np.cumsum(sizes)[sizes > 0] - 1
        symbols[last] = self.final[data[last]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.ranks[at], NONE), NONE)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(begins, len(word)))
            lowest = np.minimum.reduceat(rank, begins)
            open_ = lowest < NONE
            chosen = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank < NONE))
            if self.together:  # of overlapping pairs every other one, from the left
                first = np.append(True, np.diff(chosen) != 1)[: len(chosen)]
                run = np.flatnonzero(first)
                chosen = chosen[(chosen - np.repeat(chosen[run], np.diff(np.append(run, len(chosen))))) % 2 == 0]
            else:  # the leftmost pair only
                chosen = chosen[np.append(True, np.diff(word[chosen]) != 0)[: len(chosen)]]
            still = np.repeat(open_, lengths)
            done.append((symbols[~still], word[~still]))
            symbols[chosen] = self.made[at[chosen]]
            still[chosen + 1] = False
            symbols, word = symbols[still], word[still]
        ids, word = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space, and how many each has."""
        known: dict[bytes, int] = {s.encode(): -i - 1 for s, i in self.special.items()}
        place: dict[bytes, int] = {}
        parts, sizes = [], np.zeros(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            text, before = piece.decode(), len(parts)
            for part in self.cut_special.split(text) if self.special and "<" in text else (text,):
                if part in self.special:
                    parts.append(known[part.encode()])
                    continue
                part = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                parts += [place.setdefault(w.encode(), len(place)) for w in self.words.findall(part)]
            sizes[k] = len(parts) - before
        ids, counts = self.merged(list(place))
        # Special tokens are words of one id behind all others.
        fixed = sorted(self.special.values())
        starts = np.append(np.cumsum(counts) - counts, len(ids) + np.arange(len(fixed)))
        counts = np.append(counts, np.ones(len(fixed), np.int64))
        ids = np.append(ids, np.array(fixed, np.int64))
        at = np.array(parts, np.int64)
        special = at < 0
        at[special] = len(place) + np.searchsorted(fixed, -at[special] - 1)
        total = np.append(0, np.cumsum(counts[at]))
        ends = np.cumsum(sizes)
        return ids[ranges(starts[at], counts[at])], total[ends] - total[ends - sizes]


class Encoder:
    """A vocabulary with the pieces a worker has met, in rows: hash, bytes, ids, uses."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.byte_start = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.id_start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _add(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        if not pieces:
            return
        ids, counts = self.vocabulary.encode(pieces)
        self._append(hashes, np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), ids.astype(np.int32), counts)

    def _append(self, hashes, data, sizes, ids, counts) -> None:
        rows = len(self.uses) + np.arange(len(hashes))
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.row = np.insert(self.hashes, at, hashes[order]), np.insert(self.row, at, rows[order])
        self.byte_start = np.append(self.byte_start, self.byte_start[-1] + np.cumsum(sizes))
        self.id_start = np.append(self.id_start, self.id_start[-1] + np.cumsum(counts))
        self.bytes, self.ids = np.append(self.bytes, data), np.append(self.ids, ids)
        self.uses = np.append(self.uses, np.zeros(len(hashes), np.int64))

    def _forget(self) -> None:
        """Keeps the half of the rows met most often."""
        keep = np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2]
        inside = np.flatnonzero(np.isin(self.row, keep))
        rows, hashes, uses = self.row[inside], self.hashes[inside], self.uses[self.row[inside]]
        sizes, counts = np.diff(self.byte_start)[rows], np.diff(self.id_start)[rows]
        data = self.bytes[ranges(self.byte_start[rows], sizes)]
        ids = self.ids[ranges(self.id_start[rows], counts)]
        self._clear()
        self._append(hashes, data, sizes, ids, counts)
        self.uses[:] = uses // 2

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the last ends)."""
        data, offsets = joined(texts)
        starts, ends = runs(~SPACE[data])
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if len(self.uses) > REMEMBERED:
            self._forget()
        hashes = span_hashes(data, starts, ends)
        distinct, first, inverse, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        raw = data.tobytes()
        self._add(distinct[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        row = self.row[np.searchsorted(self.hashes, distinct)]
        self.uses[row] += times
        row = row[inverse]
        sizes = (self.byte_start[1:] - self.byte_start[:-1])[row]
        if np.array_equal(sizes, ends - starts) and np.array_equal(
            self.bytes[ranges(self.byte_start[row], sizes)], data[~SPACE[data]]
        ):
            counts = (self.id_start[1:] - self.id_start[:-1])[row]
            ids = self.ids[ranges(self.id_start[row], counts)]
        else:  # two pieces of one hash: each is encoded where it stands
            ids, counts = self.vocabulary.encode([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
            ids = ids.astype(np.int32)
        before = np.append(0, np.cumsum(counts))
        return ids, before[np.searchsorted(starts, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def decoded_texts(v: Vocabulary, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Decoded texts; ``starts`` says where each text's ids begin (and the last ends)."""
    valid = (ids >= 0) & (ids < len(v.sizes))
    valid[valid] = v.sizes[ids[valid]] > 0
    starts = np.append(0, np.cumsum(valid))[starts]
    ids = ids[valid]
    # A space goes before every token but the first of a text.
    gap = np.ones(len(ids), np.int64)
    gap[starts[:-1][starts[:-1] < starts[1:]]] = 0
    sizes = v.sizes[ids]
    ends = np.cumsum(sizes + gap)
    out = np.full(ends[-1] if len(ends) else 0, 0x20, np.uint8)
    out[ranges(ends - sizes, sizes)] = v.strings[ranges(v.starts[ids], sizes)]
    at = np.append(0, ends)[starts]
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(out)).cast(pa.string())


def _encoded(path: str, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_ = encoder(path)
        for batch in slices(batches, "text", SLICE):
            ids, starts = encode_(texts_of(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            columns = {"row": batch.column("row"), "ids": lists}
            if back:
                columns["decoded"] = decoded_texts(encode_.vocabulary, ids, starts)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, tokenizer: str, keep: list[str] | None = None, back: bool = False) -> DataFrame:
    """``row``, a struct of the columns ``keep`` (all if None), and ``ids array<int>`` of the whole text.

    With ``back`` also ``decoded``, what ``decode`` makes of the ids, in the same pass.
    """
    rows = boxed(docs, keep, text=F.col("text").cast("string"))
    fields = [rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if back:
        fields.append(T.StructField("decoded", T.StringType()))
    return rows.mapInArrow(_encoded(tokenizer, back), T.StructType(fields))


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(path).vocabulary
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
            ids = lists.flatten().fill_null(-1).to_numpy()
            starts, k = np.append(0, np.cumsum(sizes)), 0
            while k < len(batch):  # about SLICE ids at once, one long text alone
                last = max(k + 1, int(np.searchsorted(starts, starts[k] + SLICE, "right")) - 1)
                texts = decoded_texts(v, ids[starts[k] : starts[last]], starts[k : last + 1] - starts[k])
                yield pa.RecordBatch.from_arrays([*batch.slice(k, last - k).columns, texts], [*batch.schema.names, "decoded"])
                k = last

    return run


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``rows`` (with ``ids``) and ``decoded``, the text that decoding without a decoder gives."""
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_decoded(tokenizer), schema)


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: its number of ids, a digest of them and one of the text they decode to."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, tokenizer, ["doc_id"], back=True).select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
