"""Inputs of the right shape derived from the driver tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockweave.functions.labels import is_production
from shockweave.functions.numeric import ratio_nonzero
from shockweave.operators.shocks import SCENARIO_SCHEMA
from shockweave.storage import cut

YEARS = tuple(range(1995, 2002))
BASE_YEAR = 2001
MIN_YEARS = 5
USER_SECTORS = ("P_ECONOMY", "P_LARGE", "P_MEDIUM", "P_PROMO", "P_SMALL", "P_STANDARD")
HAZARD_OF_PRIORITY = {
    "geotechnical": "1-URGENT",
    "meteorological": "2-HIGH",
    "hydrological": "3-MEDIUM",
    "climatological_other": "4-NOT SPECIFIED",
    "climatological_heatwaves": "5-LOW",
}
# scenario_id, countries, sectors, supply countries, supply sectors, demand countries,
# demand sectors, supply percent, demand percent.
SCENARIOS = [
    ("S0", None, None, None, None, None, None, 0.0, 0.0),
    ("S1", ["NATION_3"], None, None, None, None, None, 10.0, 0.0),
    ("S2", ["NATION_7"], ["P_SMALL"], None, None, None, None, 5.0, 0.0),
    ("S3", None, ["P_PROMO"], None, None, None, None, 2.5, 0.0),
    ("S4", None, None, None, None, None, None, 0.0, 4.0),
]
TARGETS = [
    ("T0", None, None, None, None, None, None, 10.0, 0.0),
    ("T1", ["NATION_3"], None, None, ["P_SMALL", "P_PROMO"], None, None, 10.0, 5.0),
    ("T2", ["NATION_3"], ["P_LARGE"], None, None, [], None, 12.5, 2.5),
    ("T3", None, None, ["NATION_1", "NATION_2"], None, ["NATION_9"], ["P_MEDIUM"], 30.0, 1.0),
    ("T4", ["NATION_5"], None, [], [], None, None, 0.0, 100.0),
]


# Declared, so that no job has to read footers before a plan exists.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _user_account() -> Column:
    by_segment = (
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "HH")
        .when(F.col("c_mktsegment") == "BUILDING", "CF")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "GOV")
    )
    sector = F.element_at(F.array(*[F.lit(s) for s in USER_SECTORS]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return F.coalesce(by_segment, sector)


def flow_lines(spark: SparkSession, sf_dir: str, period: int | None = None) -> DataFrame:
    """One row per order line: who sold what to whom, and its amounts.

    A period becomes a date range on orders, which reaches the scan. Orders meet their
    customers before the lines, of which there are many more. Customers and suppliers are joined
    as read, so that Spark sees their size, and nations after them.
    """
    orders = table(spark, sf_dir, "orders")
    if period is not None:
        orders = orders.filter(
            (F.col("o_orderdate") >= F.lit(f"{period}-01-01").cast("timestamp_ntz"))
            & (F.col("o_orderdate") < F.lit(f"{period + 1}-01-01").cast("timestamp_ntz"))
        )
    nations = table(spark, sf_dir, "nation")
    buyers = nations.select(F.col("n_nationkey").alias("dest_key"), F.col("n_name").alias("c_dest"))
    sellers = nations.select(F.col("n_nationkey").alias("orig_key"), F.col("n_name").alias("c_orig"))
    bought = (
        orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(buyers, F.col("c_nationkey") == F.col("dest_key"))
        .select(
            "o_orderkey", "o_orderdate", "o_orderpriority", "c_dest", "dest_key",
            F.col("c_custkey").alias("custkey"), _user_account().alias("ind_use"),
        )
    )
    price = F.col("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(sellers, F.col("s_nationkey") == F.col("orig_key"))
        .select(
            F.year("o_orderdate").cast("int").alias("time_period"),
            "c_orig",
            F.col("p_type").alias("ptype"),
            F.col("p_brand").alias("brand"),
            "c_dest",
            "dest_key",
            "custkey",
            "ind_use",
            F.col("o_orderpriority").alias("priority"),
            F.col("l_returnflag").alias("returnflag"),
            price.alias("price"),
            (price * (1 - F.col("l_discount"))).alias("net_price"),
            (price * F.col("l_tax")).alias("tax_amount"),
            (F.col("l_quantity") * F.col("p_retailprice")).alias("volume"),
        )
    )


def _flows_of(lines: DataFrame, origin: Column, use: Column) -> DataFrame:
    """Sales to accounts plus taxes booked on ``LAB``, from one pass over the lines."""
    sale = F.struct(
        origin.alias("ind_ava"), F.col("c_dest").alias("c_dest"), use.alias("ind_use"), F.col("net_price").alias("v")
    )
    tax = F.struct(
        F.lit("LAB").alias("ind_ava"), F.col("c_orig").alias("c_dest"), origin.alias("ind_use"), F.col("tax_amount").alias("v")
    )
    return (
        lines.select("time_period", "c_orig", F.explode(F.array(sale, tax)).alias("f"))
        .groupBy("time_period", "c_orig", "f.ind_ava", "f.c_dest", "f.ind_use")
        .agg(F.sum("f.v").alias("value"))
    )


def flow_table(spark: SparkSession, sf_dir: str, period: int | None = None) -> DataFrame:
    """``(time_period, c_orig, ind_ava, c_dest, ind_use, value)``."""
    lines = flow_lines(spark, sf_dir, period)
    return _flows_of(lines, F.concat(F.lit("P_"), F.col("ptype")), F.col("ind_use"))


def newest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row with the year of the last order; no flow is newer."""
    return table(spark, sf_dir, "orders").agg(F.max(F.year("o_orderdate")).cast("int").alias("time_period"))


def detailed_flow_table(spark: SparkSession, sf_dir: str, period: int | None = None) -> DataFrame:
    """As ``flow_table`` with sector = type x brand on both sides: up to 3,750 nodes."""
    lines = flow_lines(spark, sf_dir, period)
    pairs = table(spark, sf_dir, "part").select(F.concat_ws("_", "p_type", "p_brand").alias("pair")).distinct()
    ranked = pairs.select(
        (F.row_number().over(W.orderBy("pair")) - 1).alias("pair_rank"), F.concat(F.lit("P_"), F.col("pair")).alias("pair")
    )
    lines = lines.join(ranked, F.col("custkey") % 150 == F.col("pair_rank"), "left")
    use = F.when(is_production("ind_use"), F.coalesce("pair", "ind_use")).otherwise(F.col("ind_use"))
    return _flows_of(lines, F.concat_ws("_", F.lit("P"), "ptype", "brand"), use)


def with_shares(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``share``: value over output of the using account, for production pairs."""
    users = nodes.select(F.col("country").alias("c_dest"), F.col("sector").alias("ind_use"), "x")
    share = F.when(is_production("ind_ava"), ratio_nonzero("value", "x"))
    return flows.join(users, ["c_dest", "ind_use"], "left").withColumn("share", share).drop("x")


def trade_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, volumes and returned goods by country, year and order priority, written once.

    All that calibration needs is a sum of these few rows, so order lines are joined and
    scanned once for losses by hazard, losses by year and output. Lines are added up by
    order before they meet it, so what travels is a few numbers a line.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.col("l_extendedprice").alias("price"),
        (F.col("l_returnflag") == "R").alias("back"),
    )
    amounts = {
        "price": F.col("price"),
        "volume": F.col("l_quantity") * F.col("p_retailprice"),
        "returned": F.when(F.col("back"), F.col("price")).otherwise(0.0),
    }
    nations = table(spark, sf_dir, "nation")
    by_order = (
        lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "l_suppkey", *[v.alias(n) for n, v in amounts.items()])
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations.select(F.col("n_nationkey").alias("orig_key")), F.col("s_nationkey") == F.col("orig_key"))
        .groupBy("l_orderkey")
        .agg(*[F.sum(n).alias(n) for n in amounts])
    )
    buyers = nations.select(F.col("n_nationkey").alias("dest_key"), F.col("n_name").alias("c_dest"))
    bought = (
        table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(buyers, F.col("c_nationkey") == F.col("dest_key"))
        .select(
            "o_orderkey", "c_dest", "dest_key", F.year("o_orderdate").cast("int").alias("time_period"),
            F.col("o_orderpriority").alias("priority"),
        )
    )
    return cut(
        by_order.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_dest", "dest_key", "time_period", "priority")
        .agg(*[F.sum(n).alias(n) for n in amounts])
    )


def _losses(facts: DataFrame, by: str, columns: dict[str, object]) -> DataFrame:
    sums = [F.sum(F.when(F.col(by) == v, F.col("returned")).otherwise(0.0)).alias(n) for n, v in columns.items()]
    return facts.groupBy(F.col("c_dest").alias("ISO2")).agg(*sums)


def losses_by_hazard(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Returned goods per country, one column per order priority."""
    return _losses(trade_facts(spark, sf_dir) if facts is None else facts, "priority", HAZARD_OF_PRIORITY)


def losses_by_year(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Returned goods per country, one column per year."""
    return _losses(trade_facts(spark, sf_dir) if facts is None else facts, "time_period", {f"y{y}": y for y in YEARS})


def output_cells(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """``(geo, year, unit, value)``; some cells are left out to exercise the fallbacks."""
    key, year = F.col("dest_key"), F.col("time_period")
    shown = ~((key % 7 == 3) & (year == 1995))
    with_volume = ~((key % 5 == 0) & (year == 2001))
    units = F.array(
        F.struct(F.lit("CP_MEUR").alias("unit"), F.col("price").alias("v")),
        F.when(with_volume, F.struct(F.lit("CLV20_MEUR").alias("unit"), F.col("volume").alias("v"))),
    )
    return (
        (trade_facts(spark, sf_dir) if facts is None else facts)
        .filter(shown)
        .select(F.col("c_dest").alias("geo"), year.alias("year"), F.explode(units).alias("u"))
        .filter(F.col("u").isNotNull())
        .groupBy("geo", "year", "u.unit")
        .agg(F.sum("u.v").alias("value"))
    )


def code_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    return (
        table(spark, sf_dir, "part")
        .select(
            F.when(kind.isin("SMALL", "PROMO"), "  ").otherwise(F.concat(F.lit(" "), kind, F.lit(" "))).alias("estat_s63g_code"),
            F.concat(F.lit("Detailed "), kind).alias("estat_s63g_des"),
            kind.alias("estat_s11g_code"),
            F.concat(F.lit("Broad "), kind, F.lit(" ")).alias("estat_s11g_des"),
        )
        .distinct()
    )


def country_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    return (
        table(spark, sf_dir, "nation")
        .filter(F.col("n_nationkey") < 20)
        .select(
            F.col("n_name").alias("code"),
            F.concat(F.lit("C"), key).alias("iso3"),
            F.concat(F.lit("Country "), key).alias("name"),
        )
    )


def employment_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.concat(F.lit("P_"), F.col("p_type")).alias("sector"))
        .agg((F.avg("p_size") / 1000000.0).alias("emp_per_output"))
    )


def scenarios(spark: SparkSession, rows: list[tuple] = SCENARIOS) -> DataFrame:
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("point_id"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y")
    )


def _per_geo(cells: DataFrame) -> DataFrame:
    """Cells of one country, which years and units bound, collected per payload."""
    cell = F.struct("unit", "year", "value")
    return cells.groupBy("geo").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


UNITS = ("CLV20_MEUR", "CP_MEUR")


def _unit_index(c: Column) -> Column:
    return F.when(c["unit"] == UNITS[0], 0).otherwise(1)


def jsonstat_payloads(cells: DataFrame) -> DataFrame:
    """One dense-layout payload per country.

    Map or list cells, and code lists as position maps, lists or label keys,
    alternate by country so that every variant is decoded.
    """
    n = len(YEARS)
    variant = F.pmod(F.hash("geo"), F.lit(3))
    position = lambda c: _unit_index(c) * n + (c["year"] - YEARS[0])
    sparse = F.to_json(
        F.map_from_entries(F.transform("cells", lambda c: F.struct(position(c).cast("string"), c["value"])))
    )
    by_position = F.map_from_entries(F.transform("cells", lambda c: F.struct(position(c), c["value"])))
    dense = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.lit(2 * n - 1)),
                lambda p: F.coalesce(F.try_element_at(by_position, p).cast("string"), F.lit("null")),
            ),
            ",",
        ),
        F.lit("]"),
    )
    years = [str(y) for y in YEARS]
    year_map = "{" + ",".join(f'"{y}":{k}' for k, y in enumerate(years)) + "}"
    year_list = "[" + ",".join(f'"{y}"' for y in years) + "]"
    year_labels = "{" + ",".join(f'"{y}":"Year {y}"' for y in years) + "}"
    time = (
        F.when(variant == 0, F.lit(f'{{"index":{year_map}}}'))
        .when(variant == 1, F.lit(f'{{"index":{year_list}}}'))
        .otherwise(F.lit(f'{{"label":{year_labels}}}'))
    )
    body = F.concat(
        F.lit(f'{{"id":["unit","geo","time"],"size":[2,1,{n}],"dimension":{{"unit":{{"category":{{"index":{{"CP_MEUR":1,"CLV20_MEUR":0}}}}}},"geo":{{"category":{{"index":["'),
        F.col("geo"),
        F.lit('"]}},"time":{"category":'),
        time,
        F.lit('}},"value":'),
        F.when(variant == 2, dense).otherwise(sparse),
        F.lit("}"),
    )
    return _per_geo(cells).select(F.col("geo").alias("payload_id"), body.alias("body"))


def sdmx_payloads(cells: DataFrame) -> DataFrame:
    """One series-layout payload per country, with cell keys such as ``1:0:3``."""
    years = ",".join(f'{{"id":"{y}"}}' for y in YEARS)
    key = lambda c: F.concat_ws(":", _unit_index(c).cast("string"), F.lit("0"), (c["year"] - YEARS[0]).cast("string"))
    observed = F.to_json(F.map_from_entries(F.transform("cells", lambda c: F.struct(key(c), F.array(c["value"])))))
    body = F.concat(
        F.lit('{"structure":{"dimensions":{"observation":[{"id":"unit","values":[{"id":"CLV20_MEUR"},{"id":"CP_MEUR"}]},{"id":"geo","values":[{"id":"'),
        F.col("geo"),
        F.lit(f'"}}]}},{{"id":"TIME_PERIOD","values":[{years}]}}]}}}},"dataSets":[{{"observations":'),
        observed,
        F.lit("}]}"),
    )
    return _per_geo(cells).select(F.col("geo").alias("payload_id"), body.alias("body"))


def mixed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layouts, split by country key, plus one failed answer per region."""
    cells = output_cells(spark, sf_dir)
    even = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 2 == 0).select(F.col("n_name").alias("geo"))
    failed = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("payload_id"),
        F.when(F.col("r_regionkey") % 2 == 0, F.lit('{"error":"timeout"}')).otherwise(F.lit('{"status":"busy"}')).alias("body"),
    )
    return (
        jsonstat_payloads(cells.join(even, "geo", "left_semi"))
        .unionByName(sdmx_payloads(cells.join(even, "geo", "left_anti")))
        .unionByName(failed)
    )
