import numpy as np
import pytest

from shockweave.operators import calibrate, shocks
from shockweave.sources import losses

CELLS = "geo string, unit string, year int, value double"


def cells(spark, rows):
    return spark.createDataFrame([(g, u, y, v) for g, u, y, v in rows], CELLS)


def test_constant_prices_and_fallback(spark):
    rows = [
        ("AA", "CP_MEUR", 2023, 90.0), ("AA", "CLV20_MEUR", 2023, 80.0),
        ("AA", "CP_MEUR", 2024, 120.0), ("AA", "CLV20_MEUR", 2024, 100.0),
        ("BB", "CP_MEUR", 2023, 50.0), ("BB", "CP_MEUR", 2024, 60.0),
        ("CC", "CLV20_MEUR", 2023, 10.0), ("CC", "PC", 2024, 5.0), ("DD", "CP_MEUR", 2023, None),
    ]
    got = {(r["geo"], r["year"]): r for r in calibrate.constant_price_output(cells(spark, rows)).collect()}
    assert set(got) == {("AA", 2023), ("AA", 2024), ("BB", 2023), ("BB", 2024)}
    assert got["AA", 2023]["output_mn_eur"] == pytest.approx(80 * 1.2)
    assert got["BB", 2023]["output_mn_eur"] == pytest.approx(50 * (1.2 / (90 / 80)))
    assert got["BB", 2024]["output_mn_eur"] == pytest.approx(60.0)
    assert [got[k]["used_pooled_deflator"] for k in sorted(got)] == [False, False, True, True]
    report = calibrate.fallback_report(calibrate.constant_price_output(cells(spark, rows))).first()
    assert (report["rows_on_fallback"], report["geos_on_fallback"]) == (2, ["BB"])


def test_base_year_must_exist(spark):
    with pytest.raises(Exception, match="no rows for base year 2024"):
        calibrate.constant_price_output(cells(spark, [("AA", "CP_MEUR", 2023, 1.0)])).collect()


def test_shares_skip_missing_and_zero_totals(spark):
    df = spark.createDataFrame(
        [("IT", "Italy", 6.0, 2.0, float("nan"), None, 0.0), ("MT", "Malta", 0.0, 0.0, 0.0, 0.0, 0.0)],
        "ISO2 string, Name string, geotechnical double, meteorological double, hydrological double, "
        "`Climatological (other)` double, `climatological (heatwaves)` double",
    )
    got = {(r["ISO2"], r["hazard"]): r["omega"] for r in calibrate.hazard_shares(df).collect()}
    assert got["IT", "geotechnical"] == 0.75 and got["IT", "meteorological"] == 0.25
    assert got["IT", "hydrological"] is None and got["IT", "climatological_heatwaves"] == 0.0
    assert all(v == 0.0 for (c, _), v in got.items() if c == "MT")


def test_panel_percentiles_and_scalars(spark):
    rng = np.random.default_rng(3)
    values = rng.random(12) / 5
    by_hazard = spark.createDataFrame([("IT", 3.0, 1.0), ("FR", 0.0, 2.0)], "ISO2 string, geotechnical double, hydrological double")
    years = list(range(2000, 2012))
    by_year = spark.createDataFrame(
        [("IT", *[float(100 * v) for v in values]), ("FR", *[1.0] * 12), ("XX", *[1.0] * 12)],
        "ISO2 string, " + ", ".join(f"`{y}` double" for y in years),
    )
    rows = [("IT", y, 50.0) for y in years] + [("FR", y, 10.0) for y in years[:4]] + [("XX", y, 0.0) for y in years]
    output = spark.createDataFrame(rows, "geo string, year int, output_mn_eur double")
    panel = calibrate.intensity_panel(by_hazard, by_year, output)
    table = calibrate.percentile_table(panel)
    got = {(r["ISO2"], r["hazard"]): r for r in table.collect()}
    assert set(got) == {("IT", "geotechnical"), ("IT", "hydrological")}
    for name, q in calibrate.INTENSITY_LEVELS.items():
        assert got["IT", "geotechnical"][name] == pytest.approx(np.quantile(0.75 * 100 * values / 50, q))
    requests = spark.createDataFrame(
        [("a", "IT", "geotechnical", "extreme"), ("b", "FR", "geotechnical", "extreme"), ("c", "IT", "hydrological", "mild")],
        "scenario_id string, ISO2 string, hazard string, level string",
    )
    scalars = {r["scenario_id"]: r["scalar"] for r in calibrate.shock_scalars(requests, table, clamp_max=0.2).collect()}
    assert scalars == {"a": 0.2, "b": 0.0, "c": 0.0}
    nodes = spark.createDataFrame([(0, "IT::P_1", "IT", "P_1"), (1, "FR::P_1", "FR", "P_1")], "node int, label string, country string, sector string")
    flat = shocks.flat_shocks(calibrate.shock_scalars(requests, table, 0.2), nodes).filter("scenario_id = 'a'").collect()
    assert {r["node"]: r["sp"] for r in flat} == {0: 0.2}  # only nodes that are hit


def test_grid_covers_every_combination(spark):
    countries = spark.createDataFrame([("IT",), ("FR",), ("IT",)], "country string")
    grid = shocks.scenario_grid(countries, losses.HAZARDS)
    assert grid.count() == 2 * 5 * 4 == grid.select("scenario_id").distinct().count()
