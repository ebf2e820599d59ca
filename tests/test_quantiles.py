import numpy as np
import pytest

from pyspark.sql import functions as F

from shockweave.operators.quantiles import double_bits, double_of, nearest_quantiles

QS = {"cap": 0.95, "low": 0.1, "mid": 0.5, "top": 1.0, "bottom": 0.0}


def expected(values, zeros, q):
    full = np.sort(np.concatenate([np.zeros(zeros), values]))
    return full[int(np.round((len(full) - 1) * q))]


def test_against_sorted_values(spark):
    rng = np.random.default_rng(7)
    groups = {
        "spread": (np.exp(rng.normal(0, 8, 700)), 0),
        "narrow": (1.0 + rng.random(900) * 1e-6, 40),
        "ties": (rng.integers(0, 4, 500).astype(float), 123),
        "one": (np.array([3.5]), 0),
        "mostly zero": (rng.random(50), 5000),
        "same": (np.full(300, 2.25), 0),
    }
    rows = [(g, float(v)) for g, (vs, _) in groups.items() for v in vs]
    values = spark.createDataFrame(rows, "g string, v double").repartition(5)
    zeros = spark.createDataFrame([(g, z) for g, (_, z) in groups.items()], "g string, n_zeros long")
    got = nearest_quantiles(values, ["g"], "v", QS, zeros).collect()
    assert len(got) == len(groups)
    for r in got:
        vs, z = groups[r["g"]]
        for name, q in QS.items():
            assert r[name] == expected(vs, z, q), (r["g"], name)


def test_one_group_of_all(spark):
    values = np.exp(np.random.default_rng(3).normal(0, 20, 400))
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    row = nearest_quantiles(df, [], "v", QS, spark.createDataFrame([(31,)], "n_zeros long")).first()
    assert {n: row[n] for n in QS} == {n: expected(values, 31, q) for n, q in QS.items()}
    plan = nearest_quantiles(df, [], "v", QS)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert nearest_quantiles(df.limit(0), [], "v", QS).first()["mid"] == 0.0


def test_bits_of_doubles(spark):
    edge = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1e-3, 0.5, 0.9999999999999999, 1.0, 1.0000000000000002, 8.0, 7.999999999999999]
    edge += [2.0**52 + 1, 1e300, 1.7976931348623157e308, float("inf")] + list(np.exp(np.random.default_rng(5).normal(0, 100, 500)))
    df = spark.createDataFrame([(float(v),) for v in edge], "v double").select("v", double_bits(F.col("v")).alias("b"))
    for r in df.select("*", double_of(F.col("b")).alias("back")).collect():
        assert r["b"] == int(np.float64(r["v"]).view(np.int64)) and r["back"] == r["v"]
