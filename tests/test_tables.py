"""Small literal cases for heatmap, deviation, ranking and catalog tables."""

import pytest
from pyspark.sql import functions as F

from shockweave.operators import calibrate, checks, deviation, heatmap, linkage
from shockweave.sources import dims


def by(rows, key):
    return {r[key]: r for r in rows}


def test_mean_deviation(spark):
    df = spark.createDataFrame([("IT", 12.0), ("FR", 10.0), ("DE", 8.0)], "country string, loss_pct double")
    got = by(deviation.mean_deviation(df, keys=()).collect(), "country")
    assert [got[c]["loss_pct_deviation"] for c in ("IT", "FR", "DE")] == pytest.approx([2.0, 0.0, -2.0])


def test_missing_metric_is_named(spark):
    df = spark.createDataFrame([("IT", 1.0)], "country string, wrong_metric double")
    with pytest.raises(ValueError, match="no column 'loss_pct'"):
        deviation.mean_deviation(df)


def test_missing_value_stays_missing_and_last(spark):
    df = spark.createDataFrame(
        [("A", 10.0), ("B", float("nan")), ("C", 10.0)], "sector string, loss_pct double"
    )
    rows = deviation.sector_deviations(df, mode="full_distribution", keys=()).collect()
    assert [r["sector"] for r in rows] == ["A", "C", "B"]
    assert [r["loss_pct_deviation"] for r in rows] == [0.0, 0.0, None]


def test_top_bottom_is_capped_and_ascending(spark):
    df = spark.range(80).select(
        F.lit("S").alias("scenario_id"),
        F.concat(F.lit("S"), "id").alias("sector"),
        (F.col("id") - 40).cast("double").alias("loss_pct"),
    )
    values = [r["loss_pct_deviation"] for r in deviation.sector_deviations(df, k=20).collect()]
    assert len(values) == 40 and values == sorted(values)
    assert values[0] == -39.5 and values[-1] == 39.5


def test_symmetric_range(spark):
    df = spark.createDataFrame(
        [("a", 600.0), ("a", -700.0), ("b", None), ("c", 0.0)], "scenario_id string, d double"
    )
    got = by(deviation.symmetric_range(df, "d").collect(), "scenario_id")
    assert (got["a"]["range_min"], got["a"]["range_max"]) == (-700.0, 700.0)
    assert got["b"]["range_max"] == 1.0
    assert got["c"]["range_max"] == 1e-9


def test_intensity_cap(spark):
    cells = spark.createDataFrame(
        [("a", "w", 0.0), ("a", "x", 2.0), ("a", "y", 4.0), ("a", "z", 100.0)], "src string, dst string, value double"
    )
    got = by(heatmap.with_intensity(cells, cap=0.75).collect(), "dst")
    assert [got[d]["intensity"] for d in "wxyz"] == pytest.approx([0.0, 0.5, 1.0, 1.0])


LINKS = "i_label string, j_label string, delta double, delta_rel double"


def test_heatmap_of_nothing(spark):
    assert heatmap.heatmap(spark.createDataFrame([], LINKS)).collect() == []


def test_heatmap_all_missing(spark):
    links = spark.createDataFrame([("A", "B", None, None), ("A", "C", None, None)], LINKS)
    rows = heatmap.heatmap(links, "percentage").collect()
    assert len(rows) == 2
    assert all(r["value"] == r["intensity"] == r["clip_limit"] == 0.0 for r in rows)


def test_heatmap_by_sector_and_matrix(spark):
    links = spark.createDataFrame(
        [("IT::A", "FR::B", 1.0, 0.1), ("IT::A", "DE::B", 2.0, 0.2), ("FR::B", "IT::A", 3.0, 0.3)], LINKS
    )
    cells = heatmap.heatmap_cells(links, "absolute", "sector")
    assert {(r["src"], r["dst"]): r["value"] for r in cells.collect()} == {("A", "B"): 3.0, ("B", "A"): 3.0}
    matrix = [tuple(r) for r in heatmap.as_matrix(cells, ["A", "B"]).collect()]
    assert matrix == [("A", 0.0, 3.0), ("B", 3.0, 0.0)]


def test_zero_cells_count_in_quantiles(spark):
    # 10 x 10 grid with values on the diagonal only: rank 94 of 100 is the fifth of ten values.
    diagonal = spark.range(10).select(
        F.concat(F.lit("r"), "id").alias("src"), F.concat(F.lit("c"), "id").alias("dst"), (F.col("id") + 1.0).alias("value")
    )
    got = heatmap.with_intensity(diagonal, cap=0.95, clip=0.5).collect()
    assert {r["clip_limit"] for r in got} == {0.0}
    by_src = by(got, "src")
    assert by_src["r4"]["intensity"] == 1.0 and by_src["r3"]["intensity"] == pytest.approx(4 / 5)


def test_viewport(spark):
    points = spark.createDataFrame([(-10, -5), (50, 50), (110, 200)], "x int, y int")
    rows = heatmap.map_to_viewport(points, "x", "y", (0, 100, 0, 100)).orderBy("x").collect()
    assert (rows[0]["x_mapped"], rows[0]["y_mapped"]) == (0.0, 0.0)
    assert (rows[2]["x_mapped"], rows[2]["y_mapped"]) == (100.0, 100.0)
    assert [r["in_bounds"] for r in rows] == [False, True, False]
    assert heatmap.map_to_viewport(points, "x", "y", (0, 100, 0, 100), "drop").count() == 1
    with pytest.raises(ValueError, match="mode"):
        heatmap.map_to_viewport(points, "x", "y", (0, 1, 0, 1), "wrap")


def test_combined_links(spark):
    schema = "scenario_id string, i_label string, j_label string, delta double, delta_rel double, rank int"
    weak = spark.createDataFrame([("S", "A", "B", -0.02, -0.5, 1)], schema)
    strong = spark.createDataFrame([("S", "B", "A", 0.03, 1.5, 1), ("S", "C", "A", 0.01, 0.5, 2)], schema)
    rows = [tuple(r) for r in linkage.signed_link_table(weak, strong, k=1).collect()]
    assert rows == [
        ("S", "A → B", pytest.approx(-2.0), pytest.approx(-50.0), "Weakened"),
        ("S", "B → A", pytest.approx(3.0), pytest.approx(150.0), "Strengthened"),
    ]
    none = spark.createDataFrame([], schema)
    assert linkage.signed_link_table(none, none).collect() == []


def test_catalogs(spark):
    table = spark.createDataFrame([("flood",), ("storm",), ("flood",), (None,), (" ",)], "hazard string")
    assert [r["hazard"] for r in calibrate.hazard_catalog(table).collect()] == ["flood", "storm"]
    levels = spark.createDataFrame([("extreme",), ("moderate",), ("very_extreme",), ("odd",)], "level string")
    assert [r["level"] for r in calibrate.ordered_levels(levels).collect()] == ["moderate", "extreme", "very_extreme"]


def test_iso_decoding(spark):
    countries = spark.createDataFrame([(" it ",), ("EL",), ("UK",), ("XX",)], "country string")
    got = by(dims.decode_countries(countries, dims.iso_dimension(spark)).collect(), "country")
    assert got[" it "]["iso3"] == "ITA" and got["EL"]["country_name"] == "Greece"
    assert got["UK"]["iso3"] == "GBR" and got["XX"]["iso3"] == got["XX"]["country_name"] == "XX"
    chosen = deviation.select_countries(dims.decode_countries(countries, dims.iso_dimension(spark)), ["ITA"])
    assert chosen.count() == 1


def test_sector_decoder_prefers_detailed_codes(spark):
    dim = spark.createDataFrame(
        [(" A01 ", " Crops ", "A", "Farming"), ("", "none", "B", "Mining"), (None, None, "A01", "Other"), ("A01", "Animals", "C", "Making")],
        "estat_s63g_code string, estat_s63g_des string, estat_s11g_code string, estat_s11g_des string",
    )
    names = {r["sector"]: r["sector_name"] for r in dims.sector_decoder(dim).collect()}
    assert names == {"P_A01": "Animals", "P_A": "Farming", "P_B": "Mining", "P_C": "Making"}
    wanted = spark.createDataFrame([("P_B",), ("P_B",)], "sector string")
    assert [r["sector"] for r in dims.sector_decoder(dim, wanted).collect()] == ["P_B"]


def test_label_and_range_checks(spark):
    labels = spark.createDataFrame([("IT::A",), ("IT",), ("IT::A::B",), (" ::A",), ("IT:: ",), (None,)], "label string")
    assert {r["label"] for r in checks.invalid_labels(labels).collect()} == {"IT", "IT::A::B", " ::A", "IT:: ", None}
    values = spark.createDataFrame([(0.5, 1.0), (float("nan"), 2.0), (None, -1.0), (1.0, 0.0)], "a double, b double")
    got = checks.range_violations(values, {"a": (0, 1), "b": (0, 1)}).collect()
    assert {r["column_name"]: r["violations"] for r in got} == {"a": 2, "b": 2}
