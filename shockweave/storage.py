"""Cutting lineage with tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession

_local_folder: str | None = None
_scratch: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scratch", default=())


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; on a
    cluster a machine-local path would be lost with its machine.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="shockweave-")
    return _local_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/shockweave-{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """The path's file system and the path in it, None in a session that has no access to them."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return None
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def absent(spark: SparkSession, path: str) -> bool:
    """True if there is certainly nothing at ``path``."""
    files = _files(spark, path)
    return files is not None and not files[0].exists(files[1])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table's files; a session without access to its file systems leaves them."""
    files = _files(spark, path)
    if files is not None:
        files[0].delete(files[1], True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``cut`` writes inside are removed at the end, but those it is told to keep.

    What is returned from inside must not read the others. Inside another scratch, tables can be left to that.
    """
    written: list[tuple[SparkSession, str]] = []
    token = _scratch.set((*_scratch.get(), written))
    try:
        yield
    finally:
        _scratch.reset(token)
        for spark, path in written:
            remove(spark, path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``cut`` returned and that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        remove(table.sparkSession, folder)


def cut(df: DataFrame, keep: bool = False, seen: Observation | None = None, *measures, outer: bool = False) -> DataFrame:
    """Write ``df`` once and return the written table.

    Unlike a cached or locally checkpointed plan the table outlives any
    executor, and its exact size lets Spark choose broadcast or sort-merge for
    the joins that follow. The schema is passed on, so no footer is read.
    ``measures`` are observed in ``seen`` while the table is written; with ``outer`` the table
    outlives the innermost scratch.
    """
    spark, schema = df.sparkSession, df.schema
    path = fresh_path(spark, "table")
    written = _scratch.get()[: -1 if outer else None]
    if written and not keep:
        written[-1].append((spark, path))
    (df.observe(seen, *measures) if seen is not None else df).write.parquet(path)
    return spark.read.schema(schema).parquet(path)
