"""Statistical cube payloads (JSON) decoded to long tables.

A payload row is ``(payload_id, body)``. Two encodings are read: the dense
"json-stat" layout, whose cells are numbered in row-major order and whose
missing cells still yield rows, and the "sdmx" layout, whose cells carry index
keys such as ``0:3:1`` and which lists present cells only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shockweave.functions.numeric import nan_to_null

# Names under which sources publish the three dimensions.
TIME_NAMES = ("TIME_PERIOD", "time", "TIME", "year")
GEO_NAMES = ("geo", "GEO")
UNIT_NAMES = ("unit", "UNIT")

DIMENSIONS_SCHEMA = "map<string, struct<category: struct<index: string, label: string>>>"
OBSERVED_SCHEMA = "array<struct<id: string, values: array<struct<id: string>>>>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file, identified by its path."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("payload_id"), F.col("value").alias("body")
    )


#: Parts of a body by which its layout is known and read.
PARTS = ("id", "size", "dimension", "value", "structure", "dataSets", "error")


def _opened(payloads: DataFrame) -> DataFrame:
    """``payload_id``, ``body`` and the raw text of each of its parts, from one pass over the body."""
    named = [f"p_{p}" for p in PARTS]
    return payloads.select("payload_id", "body", F.json_tuple("body", *PARTS).alias(*named))


def _tagged(opened: DataFrame) -> DataFrame:
    """Adds ``format``, ``sdmx``, ``jsonstat`` or ``error``, and for errors their ``problem``."""
    has = lambda part: F.col(f"p_{part}").isNotNull()
    layout = F.when(has("structure") & has("dataSets"), "sdmx").when(has("dimension") & has("value"), "jsonstat")
    keys = F.array_join(F.json_object_keys("body"), ", ")
    unread = F.coalesce(
        F.concat(F.lit("source reported: "), F.col("p_error")),
        F.concat(F.lit("unrecognised layout, keys: "), F.coalesce(keys, F.lit("none"))),
    )
    tagged = opened.withColumn("layout", layout)
    problem = F.when(F.col("layout").isNull(), unread).when(F.col("layout") == "jsonstat", _grid_fault())
    tagged = tagged.withColumn("problem", problem)
    return tagged.withColumn("format", F.when(F.col("problem").isNull(), F.col("layout")).otherwise("error")).drop("layout")


def with_format(payloads: DataFrame) -> DataFrame:
    """Adds ``format``: ``sdmx``, ``jsonstat``, or ``error`` with a ``problem`` text."""
    return _tagged(_opened(payloads)).select("payload_id", "body", "format", "problem")


def _grid() -> tuple[Column, Column, Column]:
    """Of a json-stat body: ids of the dimensions, their sizes, their ordered codes."""
    dims = F.from_json("p_dimension", DIMENSIONS_SCHEMA)
    ids = F.coalesce(F.from_json("p_id", "array<string>"), F.map_keys(dims))
    return ids, F.from_json("p_size", "array<int>"), F.transform(ids, lambda d: _dimension_codes(dims[d]["category"]))


def _grid_fault() -> Column:
    """What keeps a json-stat body from being decoded, NULL if nothing does."""
    raw, (ids, sizes, codes) = F.col("p_value"), _grid()
    counts = F.transform(codes, lambda c: F.size(c))
    short = F.exists(F.arrays_zip(counts.alias("n"), sizes.alias("size")), lambda c: F.coalesce(c["n"], F.lit(-1)) < c["size"])
    return (
        F.when(~(raw.startswith("{") | raw.startswith("[")), "values are neither a list nor a map")
        .when(F.coalesce(F.size(sizes) != F.size(ids), F.lit(True)), "sizes do not match the dimensions")
        .when(short, "a dimension has fewer codes than its size")
    )


def quarantined(payloads: DataFrame) -> DataFrame:
    """Payloads that cannot be decoded, with the reason."""
    return with_format(payloads).filter(F.col("format") == "error").select("payload_id", "problem")


def _dimension_codes(category: Column) -> Column:
    """Ordered codes from a position map, a list, or the keys of the labels."""
    index, label = category["index"], category["label"]
    by_position = F.transform(
        F.array_sort(
            F.transform(
                F.map_entries(F.from_json(index, "map<string, int>")),
                lambda e: F.struct(e["value"].alias("pos"), e["key"].alias("code")),
            )
        ),
        lambda e: e["code"],
    )
    return (
        F.when(index.startswith("{"), by_position)
        .when(index.startswith("["), F.from_json(index, "array<string>"))
        .otherwise(F.json_object_keys(label))
    )


def _cells() -> Column:
    """(pos, value) of the cells that a json-stat body lists, from a map or a list."""
    raw = F.col("p_value")
    keyed = F.transform(
        F.map_entries(F.from_json(raw, "map<string, double>")),
        lambda e: F.struct(e["key"].cast("long").alias("pos"), e["value"].alias("value")),
    )
    listed = F.transform(
        F.from_json(raw, "array<double>"), lambda v, k: F.struct(k.cast("long").alias("pos"), v.alias("value"))
    )
    return F.when(raw.startswith("{"), keyed).otherwise(listed)


def _dense(opened: DataFrame) -> DataFrame:
    """Rows of opened json-stat bodies as ``(payload_id, coords, value)``.

    Each body lists its own cells and the positions it lacks, so rows need no join: nothing
    is shuffled, and code lists stay with their row until positions are decoded.
    """
    ids, sizes, codes = _grid()
    consistent = F.when(F.size("sizes") == F.size("ids"), F.col("sizes")).otherwise(
        F.raise_error(F.lit("payload has no consistent 'size' array"))
    )
    total = F.aggregate("sizes", F.lit(1).cast("long"), lambda acc, s: acc * s)

    def stride(k: Column) -> Column:
        later = F.slice("sizes", k + 2, F.greatest(F.size("sizes") - k - 1, F.lit(0)))
        return F.aggregate(later, F.lit(1).cast("long"), lambda acc, s: acc * s)

    inside = F.filter("cells", lambda c: (c["pos"] >= 0) & (c["pos"] < F.col("total")) & c["value"].isNotNull())
    lacking = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), F.transform("cells", lambda c: c["pos"]))
    absent = F.transform(lacking, lambda p: F.struct(p.alias("pos"), F.lit(None).cast("double").alias("value")))
    code = lambda c, k: F.get(c, (F.floor(F.col("cell.pos") / F.get("strides", k)) % F.get("sizes", k)).cast("int"))
    return (
        opened.select("payload_id", ids.alias("ids"), sizes.alias("sizes"), codes.alias("codes"), _cells().alias("cells"))
        .withColumn("sizes", consistent)
        .withColumns({"total": total, "strides": F.transform("sizes", lambda s, k: stride(k))})
        .filter(F.col("total") > 0)
        .withColumn("cells", inside)
        .withColumn("cell", F.explode(F.concat("cells", absent)))
        .select("payload_id", F.map_from_arrays("ids", F.transform("codes", code)).alias("coords"), "cell.value")
    )


def jsonstat_to_long(payloads: DataFrame) -> DataFrame:
    """``(payload_id, coords, value)``: every cell of every grid, missing ones NULL."""
    return _dense(_opened(payloads))


def _sparse(opened: DataFrame) -> DataFrame:
    """Rows of opened sdmx bodies as ``(payload_id, coords, value)``."""
    dims = F.from_json(F.get_json_object("p_structure", "$.dimensions.observation"), OBSERVED_SCHEMA)
    cells = F.from_json(F.get_json_object("p_dataSets", "$[0].observations"), "map<string, array<double>>")
    return (
        opened.select("payload_id", dims.alias("dims"), F.explode(cells).alias("key", "cell"))
        .withColumn("at", F.transform(F.split("key", ":"), lambda p: p.cast("int")))
        .select(
            "payload_id",
            F.map_from_arrays(
                F.transform("dims", lambda d: d["id"]),
                F.transform("dims", lambda d, k: F.get(d["values"], F.get("at", k))["id"]),
            ).alias("coords"),
            F.get("cell", F.lit(0)).alias("value"),
        )
    )


def sdmx_to_long(payloads: DataFrame) -> DataFrame:
    """``(payload_id, coords, value)`` for the cells that are present."""
    return _sparse(_opened(payloads))


def payloads_to_long(payloads: DataFrame) -> DataFrame:
    """Decode every readable payload by its own layout; see ``quarantined`` for the rest."""
    tagged = _tagged(_opened(payloads))
    return _dense(tagged.filter(F.col("format") == "jsonstat")).unionByName(
        _sparse(tagged.filter(F.col("format") == "sdmx"))
    )


def _coordinate(names: Sequence[str]) -> Column:
    return F.coalesce(*[F.element_at("coords", F.lit(n)) for n in names])


def output_cells(long: DataFrame) -> DataFrame:
    """``(geo, unit, year, value)`` from decoded cells, whatever the source calls them."""
    return long.select(
        _coordinate(GEO_NAMES).alias("geo"),
        _coordinate(UNIT_NAMES).alias("unit"),
        _coordinate(TIME_NAMES).cast("int").alias("year"),
        nan_to_null("value").alias("value"),
    )
