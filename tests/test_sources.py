import json

import pytest

from shockweave.operators import calibrate
from pyspark.sql import functions as F

from shockweave import storage
from shockweave.sources import bundle, cube, flows, losses, sinks

GRID = {"id": ["unit", "geo", "time"], "size": [1, 2, 2]}


def dims(time):
    return {
        "unit": {"category": {"index": {"CP_MEUR": 0}}},
        "geo": {"category": {"index": ["IT", "FR"]}},
        "time": {"category": time},
    }


PAYLOADS = {
    "map": {**GRID, "dimension": dims({"index": {"2001": 1, "2000": 0}}), "value": {"0": 1.5, "3": 4, "9": 7, "1": None}},
    "list": {**GRID, "dimension": dims({"label": {"2000": "y0", "2001": "y1"}}), "value": [1.5, None, None, 4]},
    "short": {**GRID, "dimension": dims({"index": ["2000", "2001"]}), "value": [1.5]},
    "series": {
        "structure": {"dimensions": {"observation": [
            {"id": "UNIT", "values": [{"id": "CP_MEUR"}]},
            {"id": "GEO", "values": [{"id": "IT"}, {"id": "FR"}]},
            {"id": "TIME_PERIOD", "values": [{"id": "2000"}, {"id": "2001"}]},
        ]}},
        "dataSets": [{"observations": {"0:0:0": [1.5], "0:1:1": [4.0, 1], "0:1:0": []}}],
    },
    "failed": {"error": "timeout"},
    "odd": {"status": 1, "other": 2},
}


@pytest.fixture(scope="module")
def payloads(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cubes")
    for name, body in PAYLOADS.items():
        (folder / f"{name}.json").write_text(json.dumps(body, indent=1))
    return cube.read_payloads(spark, str(folder))


def test_cube_layouts(payloads):
    long = cube.payloads_to_long(payloads)
    got = {}
    for r in long.collect():
        name = r["payload_id"].split("/")[-1].removesuffix(".json")
        c = {k.lower(): v for k, v in r["coords"].items()}
        got.setdefault(name, {})[c["geo"], c.get("time", c.get("time_period"))] = r["value"]
    full = {("IT", "2000"): 1.5, ("IT", "2001"): None, ("FR", "2000"): None, ("FR", "2001"): 4.0}
    assert got["map"] == full and got["list"] == full
    assert got["short"] == {**full, ("FR", "2001"): None}
    assert got["series"] == {("IT", "2000"): 1.5, ("FR", "2001"): 4.0, ("FR", "2000"): None}
    assert set(got) == {"map", "list", "short", "series"}


def test_cells_use_common_names(payloads):
    cells = cube.output_cells(cube.payloads_to_long(payloads))
    assert cells.columns == ["geo", "unit", "year", "value"]
    assert {(r["geo"], r["unit"], r["year"]) for r in cells.collect()} == {
        (g, "CP_MEUR", y) for g in ("IT", "FR") for y in (2000, 2001)
    }


def test_unreadable_payloads_are_listed(payloads):
    got = {r["payload_id"].split("/")[-1]: r["problem"] for r in cube.quarantined(payloads).collect()}
    assert got == {"failed.json": "source reported: timeout", "odd.json": "unrecognised layout, keys: status, other"}


def test_inconsistent_size_fails(spark):
    body = json.dumps({"id": ["geo", "time"], "size": [2], "dimension": dims({"index": ["2000"]}), "value": {}})
    bad = spark.createDataFrame([("x", body)], "payload_id string, body string")
    with pytest.raises(Exception, match="size"):
        cube.jsonstat_to_long(bad).collect()


FLOW = "time_period int, c_orig string, ind_ava string, c_dest string, ind_use string, value double"


def test_latest_period_of_a_partitioned_table(spark, tmp_path):
    rows = [(y, "IT", "P_A", "FR", "HH", float(y)) for y in (2019, 2021, 2020)]
    path = str(tmp_path / "flows")
    spark.createDataFrame(rows, FLOW).write.partitionBy("time_period").parquet(path)
    newest = flows.latest_period(flows.read_flows(spark, path=path))
    assert [(r["time_period"], r["value"]) for r in newest.collect()] == [(2021, 2021.0)]
    assert "time_period" in newest._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    with pytest.raises(ValueError):
        flows.read_flows(spark)


def test_nan_values_count_as_missing(spark):
    rows = [(2020, "IT", "P_A", "FR", "HH", 2.0), (2020, "IT", "P_A", "FR", "HH", float("nan"))]
    assert flows.compact_flows(spark.createDataFrame(rows, FLOW)).first()["value"] == 2.0


def test_materialise_computes_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "once")
    first = sinks.materialise(spark, path, compute)
    second = sinks.materialise(spark, path, compute)
    assert first.count() == second.count() == 3 and len(calls) == 1


def test_csv_tables_and_export(spark, tmp_path):
    losses_path = str(tmp_path / "losses")
    wide = spark.createDataFrame([("IT", 1.0, None)], "ISO2 string, y2000 double, y2001 double")
    sinks.write_csv(wide, losses_path)
    _, by_year = losses.read_losses(
        spark, losses_path, losses_path, "csv", hazard_schema="ISO2 string, y2000 double, y2001 double",
        year_schema="ISO2 string, y2000 double, y2001 double",
    )
    got = {r["year"]: r["loss_total"] for r in calibrate.annual_losses(by_year).collect()}
    assert got == {2000: 1.0, 2001: None}
    with pytest.raises(ValueError, match="schema"):
        losses.read_wide_table(spark, losses_path, "csv")
    output = spark.createDataFrame([("B", 1, 1.0), ("A", 2, 2.0), ("A", 1, 3.0)], "geo string, year int, output_mn_eur double")
    sinks.export_output_series(output.coalesce(1), str(tmp_path / "series"), "parquet")
    assert [(r["geo"], r["year"]) for r in spark.read.parquet(str(tmp_path / "series")).collect()] == [("A", 1), ("A", 2), ("B", 1)]


def test_a_crashed_write_is_written_over(spark, tmp_path):
    path = tmp_path / "half"
    path.mkdir()
    (path / "_temporary").mkdir()
    assert sinks.materialise(spark, str(path), lambda: spark.range(3)).count() == 3
    assert sinks.materialise(spark, str(path), lambda: spark.range(9)).count() == 3


def test_empty_and_undecodable_grids(spark):
    grid = '{"id": ["geo"], "size": [%s], "dimension": {"geo": {"category": {%s}}}, "value": %s}'
    codes = '"index": {"IT": 0}'
    rows = [
        ("empty", grid % ("0", '"index": {}', "[]")), ("fine", grid % ("1", codes, "[2.5]")), ("scalar", grid % ("1", codes, "7")),
        ("codeless", grid % ("1", "", "[1]")), ("sizes", grid % ("1, 1", codes, "[1]")),
    ]
    payloads = spark.createDataFrame(rows, "payload_id string, body string")
    assert [(r["payload_id"], r["value"]) for r in cube.payloads_to_long(payloads).collect()] == [("fine", 2.5)]
    assert {r["payload_id"] for r in cube.quarantined(payloads).collect()} == {"scalar", "codeless", "sizes"}


def test_kept_results_follow_their_inputs(spark, tmp_path):
    source, folder, calls = str(tmp_path / "input"), str(tmp_path / "kept"), []
    spark.range(3).write.parquet(source)

    def compute():
        calls.append(1)
        return {"total": spark.read.parquet(source).groupBy().sum("id").toDF("s"), "all": spark.read.parquet(source)}

    def total(**parameters):
        return bundle.kept(spark, "sums", [source], parameters, compute, folder)["total"].first()["s"]

    assert [total(k=1), total(k=1)] == [3, 3] and len(calls) == 1
    assert total(k=2) == 3 and len(calls) == 2
    spark.range(10, 12).write.mode("append").parquet(source)
    assert [total(k=1), total(k=1)] == [24, 24] and len(calls) == 3


def test_bundles_are_seen_whole(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    assert bundle.read_bundle(spark, folder) is None
    bundle.publish({"a": spark.range(2), "b": spark.range(0)}, folder)
    first = bundle.read_bundle(spark, folder)
    assert {n: df.count() for n, df in first.items()} == {"a": 2, "b": 0}
    # A crashed publication leaves tables without a manifest, which nobody reads.
    spark.range(9).write.parquet(f"{folder}/a-half")
    assert bundle.read_bundle(spark, folder)["a"].count() == 2
    bundle.publish({"a": spark.range(5)}, folder)
    assert {n: df.count() for n, df in bundle.read_bundle(spark, folder).items()} == {"a": 5}
    assert len([p for p in (tmp_path / "bundle").iterdir() if p.name.startswith(("a-", "b-"))]) == 2
    with pytest.raises(ValueError):
        bundle.publish({}, folder)


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path))
    with storage.scratch():
        storage.cut(spark.range(3))
        kept = storage.cut(spark.range(4), keep=True)
    assert kept.count() == 4 and len(list(tmp_path.iterdir())) == 1


def test_a_large_grid_in_one_body(spark):
    n = 60_000  # cells, every third absent
    body = '{"id": ["geo", "time"], "size": [2, %d], "dimension": {"geo": {"category": {"index": ["A", "B"]}}, ' % (n // 2)
    body += '"time": {"category": {"index": [%s]}}}, "value": {%s}}' % (
        ",".join(f'"{t}"' for t in range(n // 2)), ",".join(f'"{k}": {k}.5' for k in range(n) if k % 3)
    )
    long = cube.jsonstat_to_long(spark.createDataFrame([("big", body)], "payload_id string, body string"))
    assert "Exchange" not in long._jdf.queryExecution().executedPlan().toString()
    row = long.selectExpr(
        "count(*) n", "count(value) c", "sum(value) s",
        f"count_if(value <> if(coords['geo'] = 'B', {n // 2}, 0) + cast(coords['time'] as int) + 0.5) wrong",
    ).first()
    present = [k + 0.5 for k in range(n) if k % 3]
    assert (row["n"], row["c"], row["s"], row["wrong"]) == (n, len(present), sum(present), 0)


def test_newest_period_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def touch(year: int) -> int:
        made.add(1)
        return year

    rows = [(2000, "A", 1.0), (2001, "A", 2.0), (2001, "B", 3.0), (None, "C", 4.0)]
    source = spark.createDataFrame(rows, "year int, c string, value double")
    table = source.withColumn("time_period", F.udf(touch, "int")("year")).drop("year")
    year = lambda y: spark.createDataFrame([(y,)], "y int")
    newest = flows.latest_period(table, at_most=year(2001))
    seen = made.value
    for _ in range(2):  # read from what was written
        assert sorted((r["time_period"], r["c"]) for r in newest.collect()) == [(2001, "A"), (2001, "B")]
    assert made.value == seen
    # A bound that no flow reaches, or none at all, leaves the maximum to the flows themselves.
    for bound in (year(2005), year(None)):
        assert sorted(r["value"] for r in flows.latest_period(table, at_most=bound).collect()) == [2.0, 3.0]
    assert flows.latest_period(table.limit(0), at_most=year(None)).collect() == []
