"""Named tables published together, and results kept under a key of what they were computed from.

A bundle is a folder: every table is written under a name of its own, then a manifest that
lists them. Readers go by the manifest, so they see all tables of one publication or none;
what a crashed run left is never read, and publishing again replaces the manifest whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import cache
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shockweave.storage import absent, remove, shared_folder

MANIFEST = "name string, path string, schema string"
NOT_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _manifest(spark: SparkSession, folder: str) -> list:
    if absent(spark, f"{folder}/manifest"):
        return []
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("name").collect()  # a row a table
    except AnalysisException as err:
        if err.getCondition() not in NOT_THERE:
            raise
        return []


def publish(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write all ``tables``, then the manifest; tables of an earlier publication go last."""
    if not tables:
        raise ValueError("a bundle needs at least one table")
    spark = next(iter(tables.values())).sparkSession
    before, rows = _manifest(spark, folder), []
    for name, df in tables.items():
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        rows.append((name, path, df.schema.json()))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    for old in before:
        remove(spark, old["path"])


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The tables of the last complete publication, None if there is none."""
    tables = {
        row["name"]: spark.read.schema(StructType.fromJson(json.loads(row["schema"]))).parquet(row["path"])
        for row in _manifest(spark, folder)
    }
    return tables or None


def input_state(spark: SparkSession, paths: Sequence[str]) -> list[int]:
    """Checksum of the names, sizes and times of all files below ``paths``.

    Files are listed, not read; the driver sees one row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    digest = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(
        F.count("*").alias("n"), F.bit_xor(digest).alias("x"), F.sum(F.shiftright(digest, 16)).alias("s")
    ).first()
    return [row["n"], row["x"] or 0, row["s"] or 0]


@cache
def code_state() -> str:
    """Checksum of this package's sources, so that results of other code are not taken for this code's."""
    files = sorted(Path(__file__).resolve().parent.parent.glob("[!l]*/*.py"))
    return hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()


def result_key(spark: SparkSession, name: str, inputs: Sequence[str], parameters: Mapping[str, object]) -> str:
    """A name that changes with the inputs' files, with the parameters and with the code."""
    state = json.dumps([code_state(), input_state(spark, sorted(inputs)), dict(parameters)], sort_keys=True, default=str)
    return f"{name}-{hashlib.sha256(state.encode()).hexdigest()[:32]}"


def kept(
    spark: SparkSession,
    name: str,
    inputs: Sequence[str],
    parameters: Mapping[str, object],
    compute: Callable[[], Mapping[str, DataFrame]],
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """Tables that ``compute`` gives, computed once for the given inputs and parameters.

    A changed, added or removed input file or another parameter leads to another key, so a
    stale result is never read.
    """
    place = f"{folder or shared_folder(spark)}/{result_key(spark, name, inputs, parameters)}"
    found = read_bundle(spark, place)
    if found is None:
        publish(compute(), place)
        found = read_bundle(spark, place)
    return found
