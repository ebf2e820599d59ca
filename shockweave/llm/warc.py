"""Deterministic sharded WARC files.

Records are sorted by page_id and digest; shards begin where the running size of all records
passes a multiple of the shard size, so they do not depend on partitions or attempts. Inside
a shard files roll by compressed size. Headers, record ids and digests are made anew from the payload. Tasks
write under temporary names; the files of the committed tasks are then given their final
names and listed in a manifest table, so a lost executor leaves at worst a stray temporary
file.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest
page_id is a response and the others are revisits without payload.

Defined results: null html is an empty payload; a null page_id sorts first and counts as
the largest when the response is chosen; repeated rows with the smallest page_id are all
responses; a null url gives a record without target; line breaks in a url are escaped; a
table without rows gives no files; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockweave.llm.files import moved, opened, put
from shockweave.llm.tables import running_totals, slices
from shockweave.storage import cut, fresh_path

SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
#: Shards grow instead of becoming more than these; a record's headers count as so many bytes.
MOST_SHARDS = 1 << 18
HEAD_BYTES = 512
#: Fixed values of the format.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {sha1}')}>"


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One gzip member; without a time stamp, so equal records are equal bytes."""
    head = {"WARC-Type": kind, "WARC-Date": DATE} | fields
    head |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(
    page_id: int | None, url: str | None, sha1: bytes, size: int, payload: bytes | None, refers_to: int | None
) -> bytes:
    """The response with ``payload``, or without one the revisit of the response of page ``refers_to``."""
    name, revisit = base64.b32encode(sha1).decode(), payload is None
    fields = {"WARC-Record-ID": record_id(page_id, name), "WARC-Payload-Digest": f"sha1:{name}"}
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)
    if revisit:
        fields |= {"WARC-Refers-To": record_id(refers_to, name), "X-Refers-To-Page-Id": str(refers_to), "WARC-Profile": PROFILE}
    fields["Content-Type"] = "application/http; msgtype=response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", fields, http + (payload or b""))


def places(page_ids: pa.Array, sha1s: pa.Array) -> np.ndarray:
    """Keys in the order of page_id, null first, then of the digest's first bytes."""
    ids = page_ids.fill_null(-(1 << 63)).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    heads = np.frombuffer(b"".join(x[:8] for x in sha1s.to_pylist()), np.uint8).reshape(-1, 8)
    return np.concatenate([ids.astype(">u8").view(np.uint8).reshape(-1, 8), heads], 1).view("S16").ravel()


ROUTED = "shard int, page_id long, sha1 binary, page boolean, refers_to long, url string, size long, record binary"


def _routed(bounds):
    """Each row's shard; of pages also the record as a response, compressed before it travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            page_ids, sha1s = batch.column("page_id"), batch.column("sha1")
            shards = np.searchsorted(bounds.value, places(page_ids, sha1s), "right") - 1
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "size", "payload")]
            made = [None if row[-1] is None else page_record(*row, None) for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.maximum(shards, 0).astype(np.int32)), page_ids, sha1s, batch.column("payload").is_valid(),
                    batch.column("refers_to"), batch.column("url"), batch.column("size"), pa.array(made, pa.binary()),
                ],
                ["shard", "page_id", "sha1", "page", "refers_to", "url", "size", "record"],
            )

    return run


def _written(folder: str, roll: int):
    """Files of the rows of a shard, sorted; what pages revisit comes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, now, at, n, told, other = None, [], None, 0, 0, None, None

        def close():
            out.close()
            rows.append({"temporary": now[2], "final": now[3], "records": n, "bytes": at})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "page_id", "sha1", "page", "refers_to", "url", "size", "record")]
            for shard, page_id, sha1, page, refers_to, url, size, data in zip(*columns):
                if not page:
                    told, other = (page_id, sha1), refers_to
                    continue
                if told == (page_id, sha1):
                    data = page_record(page_id, url, sha1, size, None, other)
                if out is None or now[0] != shard or at >= roll:
                    part = 0 if now is None or now[0] != shard else now[1] + 1
                    if out is not None:
                        close()
                    name = f"{shard:06d}-{part:04d}.warc.gz"
                    now = (shard, part, f"{folder}/.{name}.{uuid.uuid4().hex}", f"{folder}/{name}")
                    fs, path = opened(now[2])
                    out = fs.open_output_stream(path, compression=None)
                    about = f"software: shockweave\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
                    info = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>", "WARC-Filename": name, "Content-Type": "application/warc-fields"}
                    at, n = out.write(record("warcinfo", info, about)), 0
                at += out.write(data)
                n += 1
        if out is not None:
            close()
        schema = pa.schema([("temporary", pa.string()), ("final", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _committed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column("temporary").to_pylist(), batch.column("final").to_pylist()):
            moved(a, b)
        yield batch.select(["final", "records", "bytes"]).rename_columns(["path", "records", "bytes"])


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record per row and returns the manifest: path, records, bytes of every file."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    put(f"{folder}/README", b"WARC files; those listed in the manifest are complete.\n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"sha1": F.unhex(F.sha1("payload")), "size": F.length("payload").cast("long")})
    # Order, shards and revisits are settled without payloads, which travel once.
    weighed = rows.select("page_id", "sha1", "size", (F.col("size") + HEAD_BYTES).alias("weight"))
    light = cut(running_totals(weighed, ["page_id", "sha1"], {"weight": "start"}, parts))
    total = light.agg(F.sum("weight")).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    first = F.min(F.struct("start", "page_id", "sha1")).alias("first")
    begins = light.groupBy(F.expr(f"start div {shard_bytes}").alias("shard")).agg(first).orderBy("shard").select("first.*").toArrow()
    bounds = np.sort(np.concatenate([places(b.column("page_id"), b.column("sha1")) for b in begins.to_batches()] or [np.zeros(0, "S16")]))
    shared = spark.sparkContext.broadcast(bounds)  # 16 bytes a shard, MOST_SHARDS and one at most
    copies = (
        light.where(F.col("size") >= min_bytes).groupBy("sha1")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1 and refers_to is not null").select("sha1", "refers_to")
    )
    named = ["page_id", "sha1", "refers_to", "url", "size", "payload"]
    revisits = (
        light.select("page_id", "sha1").join(copies, "sha1").where("not (page_id <=> refers_to)").distinct()
        .selectExpr("page_id", "sha1", "refers_to", "string(null) as url", "bigint(null) as size", "binary(null) as payload")
    )
    records = rows.withColumn("refers_to", F.lit(None).cast("long")).select(named).unionByName(revisits)
    placed = records.mapInArrow(_routed(shared), ROUTED).repartition(parts, "shard").sortWithinPartitions(
        "shard", "page_id", "sha1", "page", "url"
    )
    written = cut(placed.mapInArrow(_written(folder, roll_bytes), "temporary string, final string, records long, bytes long"))
    return cut(written.repartition(parts).mapInArrow(_committed, "path string, records long, bytes long"))


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file, one gzip member at a time."""
    fs, at = opened(path)
    with fs.open_input_stream(at, compression=None) as source:
        rest = b""
        while True:
            member, parts = zlib.decompressobj(31), []
            while not member.eof:
                rest = rest or source.read(1 << 20)
                if not rest:
                    if parts:
                        raise EOFError(f"{path} ends within a record")
                    return
                parts.append(member.decompress(rest))
                rest = b""
            rest = member.unused_data
            head, _, body = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a record: {lines[0]!r}")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            block = body[: int(fields["Content-Length"])]
            if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                raise ValueError(f"a block of {path} is not what was written")
            yield fields, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))))
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = []
            for fields, block in records(path):
                kind = fields["WARC-Type"]
                if kind == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != size or digest(payload) != sha1):
                    raise ValueError(f"a payload of {path} is not what was written")
                page, other = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                rows.append((page and int(page), size, sha1, kind, other and int(other)))
                if len(rows) == 5000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                    rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)


def read_warc(manifest: DataFrame) -> DataFrame:
    """Per record, from the files: page, payload size and digest, type, the page it refers to."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts).mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
