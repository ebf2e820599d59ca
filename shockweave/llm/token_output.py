"""Token ids of documents in binary shards with one shared zstandard dictionary.

Documents are ordered by doc_id over ranges; a task encodes its range and writes one file.
Each document is a zstandard frame of its own, compressed with a dictionary that is trained
once on the serialized ids of a bounded sample, so short documents stay small and can be
read alone. Attempts write to names of their own and return them as rows: the manifest
holds the files of exactly the tasks that Spark committed.

File: 8 bytes magic, 32 bytes SHA-256 of the dictionary, 1 byte id width, the frames, the
index (per document: id, whether the id is null, offset, length, number of ids), then the
index's offset and the number of documents.

Texts are encoded by ``bpe``, which refuses tokenizer files it cannot encode exactly.

Defined results: a null or empty text has the end id only; rows without doc_id come first;
repeated rows are written as often as they stand there, ties ordered by a hash of the text; a table
without rows gives no shards; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockweave.llm.bpe import Vocabulary, encoder
from shockweave.llm.files import get, opened, put
from shockweave.llm.tables import slices, texts_of
from shockweave.storage import cut, fresh_path

MAGIC = b"TOKIDS01"
#: The dictionary is trained on at most so many documents, so many ids of each.
SAMPLE_DOCS = 1000
SAMPLE_IDS = 2048
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
INDEX = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n_ids", "<u4")])
MANIFEST = "shard int, path string, documents long, ids long, bytes long"


def encoded(path: str, texts: list[bytes]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    ids, starts = encoder(path)(texts)
    raw = ids.astype("<u4").tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = [x[: 4 * SAMPLE_IDS] for x in encoded(path, texts_of(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return run


def packed(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def unpacked(data: bytes, width: int) -> bytes:
    return np.frombuffer(data, "<u2").astype("<u4").tobytes() if width == 2 else data


def train_dictionary(docs: DataFrame, tokenizer: str, width: int) -> bytes:
    """A dictionary from the documents with the smallest hashes; raw ids if they are too few."""
    sample = docs.select("text").orderBy(F.xxhash64("text"), "text").limit(SAMPLE_DOCS)
    ids = [packed(bytes(r.ids), width) for r in sample.repartition(8).mapInArrow(_ids(tokenizer), "ids binary").collect()]
    ids.sort()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(ids)[-DICTIONARY_BYTES:]


def zstd_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _written(folder: str, tokenizer: str, end_id: int, width: int, dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        data = dictionary.value
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstd_dictionary(data), write_content_size=True)
        path, out, index, end = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.ids", None, [], struct.pack("<I", end_id)
        for batch in slices(batches, "text"):
            if out is None:
                fs, at = opened(path)
                out = fs.open_output_stream(at, compression=None)
                place = out.write(MAGIC + hashlib.sha256(data).digest() + bytes([width]))
            rows = np.zeros(len(batch), INDEX)
            ids = [x + end for x in encoded(tokenizer, texts_of(batch.column("text")))]
            frames = [press.compress(packed(x, width)) for x in ids]
            names = batch.column("doc_id")
            rows["doc_id"], rows["no_id"] = names.fill_null(0).to_numpy(), names.is_null().to_numpy(False)
            rows["length"], rows["n_ids"] = [len(x) for x in frames], [len(x) // 4 for x in ids]
            rows["offset"] = place + np.cumsum(rows["length"]) - rows["length"]
            place += out.write(b"".join(frames))
            index.append(rows)
        if out is not None:
            rows = np.concatenate(index)
            out.write(rows.tobytes() + struct.pack("<QQ", place, len(rows)))
            size = out.tell()
            out.close()
            values = [shard, path, len(rows), int(rows["n_ids"].sum(dtype=np.int64)), size]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("shard", "path", "documents", "ids", "bytes"), values))],
                pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]),
            )

    return run


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes all documents and returns the manifest, one row a shard, in doc_id order."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = folder or fresh_path(spark, "ids")
    width = 2 if max(len(Vocabulary(tokenizer).sizes), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, width)
    put(f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.dictionary", dictionary)
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return cut(placed.mapInArrow(_written(folder, tokenizer, end_id, width, shared), MANIFEST))


class Shard:
    """A shard file open for reading; documents by their place in it."""

    def __init__(self, path: str):
        self.fs, at = opened(path)
        self.file = self.fs.open_input_file(at)
        head = self.file.read(len(MAGIC) + 33)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a shard: {path}")
        digest, self.width = head[len(MAGIC) : -1], head[-1]
        dictionary = get(f"{path.rpartition('/')[0]}/{digest.hex()}.dictionary")
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {path} is not the one it was written with")
        self.press = zstandard.ZstdDecompressor(dict_data=zstd_dictionary(dictionary))
        size = self.file.size()
        self.file.seek(size - 16)
        place, n = struct.unpack("<QQ", self.file.read(16))
        self.file.seek(place)
        self.index = np.frombuffer(self.file.read(n * INDEX.itemsize), INDEX)

    def ids(self, k: int) -> bytes:
        row = self.index[k]
        self.file.seek(int(row["offset"]))
        return unpacked(self.press.decompress(self.file.read(int(row["length"]))), self.width)

    def blocks(self, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """All documents in order, read in blocks of about ``most`` compressed bytes."""
        k = 0
        while k < len(self.index):
            last = int(np.searchsorted(self.index["offset"], self.index["offset"][k] + most))
            rows = self.index[k : max(last, k + 1)]
            base = int(rows["offset"][0])
            self.file.seek(base)
            data = self.file.read(int(rows["offset"][-1]) + int(rows["length"][-1]) - base)
            yield rows, [
                unpacked(self.press.decompress(data[o - base : o - base + n]), self.width)
                for o, n in zip(rows["offset"].tolist(), rows["length"].tolist())
            ]
            k += len(rows)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, path, base in zip(*[batch.column(c).to_pylist() for c in ("shard", "path", "base")]):
            for rows, ids in Shard(path).blocks():
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows["doc_id"].astype(np.int64), mask=rows["no_id"].astype(bool)),
                        pa.array(base + np.cumsum(counts) - counts),
                        pa.array(counts),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([shard] * len(ids), pa.int32()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )
                base += int(counts.sum())


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: where its ids start, how many there are, their checksum."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.select("shard", "path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, "shard").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
    )
