"""Batch runs against a dense brute force of the same definitions on a small network."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockweave import storage
from shockweave.operators import checks, impact, linkage, network, propagate, required, shocks
from shockweave.plans import stress, suite
from shockweave.sources import flows

COUNTRIES, SECTORS = ("AA", "BB", "CC"), ("P_1", "P_2", "P_3", "P_4")
LABELS = [f"{c}::{s}" for c in COUNTRIES for s in SECTORS]
SECTOR_OF = np.array([k % len(SECTORS) for k in range(len(LABELS))])
N = len(LABELS)


@pytest.fixture(scope="module")
def economy():
    """Sparse random flows; every node sells to final demand, one buys nothing."""
    rng = np.random.default_rng(11)
    z = rng.random((N, N)) * 10 * (rng.random((N, N)) < 0.4)
    z[:, 5] = 0.0
    fd = 20 + 60 * rng.random(N)
    return z, fd, z.sum(axis=1) + fd


@pytest.fixture(scope="module")
def net(spark, economy):
    z, fd, x = economy
    rows = []
    for i in range(N):
        c, s = LABELS[i].split("::")
        for j in np.nonzero(z[i])[0]:
            dc, ds = LABELS[j].split("::")
            rows += [(2000, c, s, dc, ds, float(v), float(v / x[j])) for v in (0.25 * z[i, j], 0.75 * z[i, j])]
        rows += [(2000, c, s, c, "HH", float(fd[i]), 0.0), (2000, "AA", "LAB", c, s, 1.0, 0.0), (1999, c, s, c, "HH", 7.0, 0.0)]
    table = spark.createDataFrame(
        rows, "time_period int, c_orig string, ind_ava string, c_dest string, ind_use string, value double, share double"
    )
    return network.build_network(flows.latest_period(table))


SCENARIOS = [
    ("none", None, None, None, None, None, None, 0.0, 0.0),
    ("country", ["BB"], None, None, None, None, None, 20.0, 0.0),
    ("both", None, ["P_2"], None, ["P_2", "P_3"], ["CC"], None, 12.0, 30.0),
    ("everyone", None, None, None, None, None, None, 5.0, 5.0),
]


def dense_shocks(row):
    _, c, s, sc, ss, dc, ds, sup, dem = row

    def hit(countries, sectors):
        return np.array(
            [(not countries or lab[:2] in countries) and (not sectors or lab[4:] in sectors) for lab in LABELS], dtype=float
        )

    sp = hit(sc if sc is not None else c, ss if ss is not None else s) * sup / 100
    sd = hit(dc if dc is not None else c, ds if ds is not None else s) * dem / 100
    return sd, sp


def dense_run(economy, sd, sp, gamma, max_iter, tol):
    """The definitions written out on dense arrays."""
    z, fd0, x0 = economy
    a = z / x0
    inverse = np.linalg.inv(np.eye(N) - a)
    member = (SECTOR_OF[:, None] == np.arange(len(SECTORS))[None, :]).astype(float)
    ag = (member.T @ z) / x0
    cap, fd = x0 * (1 - sp), fd0 * (1 - sd)
    for it in range(1, max_iter + 1):
        xdem = inverse @ fd
        r = np.minimum(1, cap / xdem)
        s = np.where(a > 0, r[:, None], 1.0).min(axis=0)
        con, need = z * np.minimum(s, 1 - sp)[:, None], a * xdem
        base, unmet = np.minimum(con, need), np.maximum(need - con, 0)
        inv = np.maximum(cap - fd - con.sum(axis=1), 0)
        inv_s, unmet_s = member.T @ inv, member.T @ unmet.sum(axis=1)
        frac = gamma * np.minimum(1, np.divide(inv_s, unmet_s, out=np.zeros_like(inv_s), where=unmet_s > 0))
        delivered = frac[:, None] * (member.T @ unmet)
        share = np.divide(inv, inv_s[SECTOR_OF], out=np.zeros(N), where=inv_s[SECTOR_OF] > 0)
        z1 = base + share[:, None] * delivered[SECTOR_OF]
        xl = fd + z1.sum(axis=1)
        ratio = np.where(ag > 0, np.divide(member.T @ z1, ag, out=np.zeros_like(ag), where=ag > 0), np.inf).min(axis=0)
        xg = np.where(np.isinf(ratio), xl, ratio)
        xs = np.minimum(xl, xg)
        implied = np.maximum(xs - z1.sum(axis=1), 0)
        nxt = np.minimum(fd, implied)
        gap = np.abs(nxt - fd).sum() / (np.abs(fd).sum() + 1e-12)
        fd = nxt
        if gap < tol:
            break
    return {"it": it, "ok": gap < tol, "xs": xs, "xl": xl, "xg": xg, "fd": fd, "implied": implied, "z1": z1}


@pytest.fixture(scope="module")
def runs(spark, net, economy):
    scenarios = spark.createDataFrame(SCENARIOS, shocks.SCENARIO_SCHEMA)
    vectors = shocks.targeted_shocks(scenarios, net.nodes)
    controls = {"gamma": 0.4, "max_iter": 6, "tol": 1e-3}
    result = stress.run(net, vectors, **controls, inner_tol=1e-11, return_history=True, scenarios=scenarios)
    dense = {row[0]: dense_run(economy, *dense_shocks(row), **controls) for row in SCENARIOS}
    return result, dense


def test_network_tables(net, economy):
    z, fd, x = economy
    nodes = sorted(net.nodes.collect(), key=lambda r: r["node"])
    assert [r["label"] for r in nodes] == LABELS
    assert [r["globsec"] for r in nodes] == list(SECTOR_OF)
    np.testing.assert_allclose([r["fd"] for r in nodes], fd)
    np.testing.assert_allclose([r["x"] for r in nodes], x)
    np.testing.assert_allclose([r["z_col"] for r in nodes], z.sum(axis=0))
    edges = net.edges.collect()
    assert len(edges) == np.count_nonzero(z)
    for e in edges:
        assert e["z"] == pytest.approx(z[e["i"], e["j"]]) and e["a"] == pytest.approx(z[e["i"], e["j"]] / x[e["j"]])


def test_sanity_report(net):
    row = checks.network_sanity(net.nodes, net.edges).first()
    assert row["n_nodes"] == N and row["min_z"] == 0.0 and row["accounting_gap"] == pytest.approx(0.0, abs=1e-9)


def test_required_output(spark, net, economy):
    z, fd, x = economy
    start = net.nodes.select(F.lit("s").alias("scenario_id"), "node", (F.col("fd") * 0.5).alias("v"))
    ratio = required.shrink_ratio(net)
    assert ratio == pytest.approx(max(abs(np.linalg.eigvals(z / x))), rel=0.05)
    got = required.solve(net, start, float(x.max()), 1e-13, ratio)
    np.testing.assert_allclose([r["v"] for r in got.orderBy("node").collect()], x / 2, rtol=1e-9)


def test_unbounded_coefficients_are_reported(spark, net):
    growing = replace(net, edges=net.edges.withColumn("a", F.lit(1.0)))
    start = net.nodes.select(F.lit("s").alias("scenario_id"), "node", F.col("fd").alias("v"))
    with pytest.raises(RuntimeError, match="did not settle"):
        required.solve(growing, start, 1.0, 1e-6, 0.0, max_rounds=7)


def test_runs_match_brute_force(runs):
    result, dense = runs
    rows = result.nodes.collect()
    assert len(rows) == N * len(SCENARIOS)
    for r in rows:
        d, k = dense[r["scenario_id"]], r["node"]
        assert (r["iterations"], r["converged"]) == (d["it"], d["ok"])
        for ours, theirs in (("xs", "xs"), ("xl", "xl"), ("xg", "xg"), ("fd_next", "fd"), ("fd_implied", "implied")):
            assert r[ours] == pytest.approx(d[theirs][k], rel=1e-7, abs=1e-7), (r["scenario_id"], k, ours)
        assert r["z_col"] == pytest.approx(d["z1"][:, k].sum(), rel=1e-7, abs=1e-7)


def test_final_edges_match_brute_force(runs, economy):
    result, dense = runs
    got = {(r["scenario_id"], r["i"], r["j"]): (r["z0"], r["z1"]) for r in result.edges().collect()}
    for name, d in dense.items():
        for i in range(N):
            for j in range(N):
                z0, z1 = got.get((name, i, j), (0.0, 0.0))
                assert z0 == pytest.approx(economy[0][i, j]) and z1 == pytest.approx(d["z1"][i, j], rel=1e-7, abs=1e-7)


def test_invariants(runs, economy):
    result, _ = runs
    bad = result.nodes.filter(
        (F.col("fd_next") > F.col("fd") * (1 + 1e-12)) | (F.col("r") > 1) | (F.col("s") > 1) | (F.col("s") < 0)
        | (F.col("xs") > F.col("xl") * (1 + 1e-12))
    )
    assert bad.count() == 0
    calm = result.nodes.filter("scenario_id = 'none'").agg(F.max(F.abs(F.col("x0") - F.col("xs")))).first()[0]
    assert calm < 1e-8 * economy[2].max()
    history = result.history.groupBy("scenario_id").agg(F.max("iteration").alias("n")).collect()
    assert {r["scenario_id"]: r["n"] for r in history} == {
        r["scenario_id"]: r["iterations"] for r in result.nodes.select("scenario_id", "iterations").distinct().collect()
    }


def test_impact_tables(spark, runs, economy):
    result, dense = runs
    z, fd, x = economy
    jobs = result.network.nodes.select("node", F.lit(0.001).alias("emp_per_output"))
    tables = suite.impact_tables(result, employment_per_output=jobs, top_k=5)
    assert set(tables) == {"nodes", "country", "sector", "links_weakened", "links_strengthened", "links_all", "totals"}
    country = {(r["scenario_id"], r["country"]): r for r in tables["country"].collect()}
    sector = tables["sector"].groupBy("scenario_id").agg(F.sum("loss_abs").alias("s")).collect()
    for r in sector:
        lost = (x - dense[r["scenario_id"]]["xs"]).sum()
        assert r["s"] == pytest.approx(lost, abs=1e-6)
        assert sum(country[(r["scenario_id"], c)]["loss_abs"] for c in COUNTRIES) == pytest.approx(lost, abs=1e-6)
    totals = {r["scenario_id"]: r for r in tables["totals"].collect()}
    d = dense["country"]
    assert totals["country"]["VA_final_total"] == pytest.approx(np.maximum(d["xs"] - d["z1"].sum(axis=0), 0).sum(), rel=1e-7)
    assert totals["country"]["EMP_loss_abs_total"] == pytest.approx(0.001 * (x - d["xs"]).sum(), rel=1e-6)
    weak = tables["links_weakened"].filter("scenario_id = 'country'").orderBy("rank").collect()
    delta = d["z1"] / d["xs"] - z / x
    present = np.where((z != 0) | (d["z1"] != 0), delta, 0)
    assert [r["delta"] for r in weak] == pytest.approx(sorted(present.ravel())[:5], rel=1e-6)


def test_small_baseline_mask(spark):
    links = spark.createDataFrame(
        [("s", 0, 1, 5.0, 1.0, -4.0, -0.8), ("s", 1, 0, 50.0, 49.0, -1.0, -0.02)],
        "scenario_id string, i int, j int, baseline double, final double, delta double, delta_rel double",
    )
    top = linkage.top_links(links, "weakened", k=2, min_baseline=10.0).orderBy("rank").collect()
    assert [(r["i"], r["delta"], r["delta_rel"]) for r in top] == [(1, -1.0, -0.02), (0, 0.0, -0.8)]
    top = linkage.top_links(links, "weakened", k=2, min_baseline=10.0, metric="A").orderBy("rank").collect()
    assert [(r["i"], r["baseline"], r["delta"]) for r in top] == [(0, 5.0, -4.0), (1, 50.0, -1.0)]


def test_given_value_added_and_employment(spark, net):
    final = net.nodes.select(F.lit("s").alias("scenario_id"), "node", (F.col("x") / 2).alias("xs"), F.col("z_col"))
    given = net.nodes.select("node", F.lit(3.0).alias("va0"), F.lit(8.0).alias("emp0"))
    row = impact.node_impacts(final, net.nodes, value_added=given, employment=given).first()
    assert row["VA_baseline"] == 3.0 and row["EMP_final"] == pytest.approx(4.0) and row["EMP_loss_pct"] == pytest.approx(50.0)


def test_arguments_are_checked(spark, net):
    for bad in ({"gamma": 1.5}, {"max_iter": 0}, {"tol": 0.0}):
        with pytest.raises(ValueError):
            stress.run(net, None, **bad)
    for sp in (1.7, -0.1, None):
        given = net.nodes.select(F.lit("s").alias("scenario_id"), "node", F.lit(0.0).alias("sd"), F.lit(sp).cast("double").alias("sp"))
        with pytest.raises(ValueError, match="outside"):
            stress.run(net, given)
    with pytest.raises(ValueError, match="gamma"):
        propagate.step(net, None, -0.1)
    with pytest.raises(ValueError, match="coefficients"):
        network.with_coefficients(net.edges, net.nodes, "guess")
    wild = spark.createDataFrame([("w", None, None, None, None, None, None, 120.0, 0.0)], shocks.SCENARIO_SCHEMA)
    with pytest.raises(Exception, match=r"supply_pct must be in \[0, 100\]"):
        shocks.targeted_shocks(wild, net.nodes).collect()


def test_total_requirements_are_the_inverse(net, economy):
    z, _, x = economy
    inverse = np.linalg.inv(np.eye(N) - z / x)
    got = np.zeros((N, N))
    for r in required.total_requirements(net).collect():
        got[r["i"], r["j"]] = r["v"]
    np.testing.assert_allclose(got, inverse, atol=1e-14)
    with pytest.raises(RuntimeError, match="do not vanish"):
        required.total_requirements(replace(net, edges=net.edges.withColumn("a", F.lit(1.0))), most=3)


def test_runs_with_requirements_match_those_without(spark, net, runs):
    scenarios = spark.createDataFrame(SCENARIOS, shocks.SCENARIO_SCHEMA)
    result = stress.run(
        net, shocks.targeted_shocks(scenarios, net.nodes), gamma=0.4, max_iter=6, tol=1e-3,
        scenarios=scenarios, requirements=required.total_requirements(net),
    )
    other = runs[0].nodes.select("scenario_id", "node", F.col("xs").alias("xs2"), F.col("iterations").alias("it2"))
    both = result.nodes.join(other, ["scenario_id", "node"])
    assert both.count() == N * len(SCENARIOS)
    assert both.filter((F.abs(F.col("xs") - F.col("xs2")) > 1e-6) | (F.col("iterations") != F.col("it2"))).count() == 0


def in_grid(net, side):
    """The same network placed in a grid of ``side`` x ``side`` blocks."""
    return replace(net, edges=network.in_blocks(net.edges.drop("block"), side), side=side)


def test_blocks_change_nothing(spark, net, runs):
    scenarios = spark.createDataFrame(SCENARIOS, shocks.SCENARIO_SCHEMA)
    state = propagate.initial_state(net.nodes, shocks.targeted_shocks(scenarios, net.nodes), scenarios).withColumn("xdem", F.col("x0"))
    rows = [
        {(r["scenario_id"], r["node"]): r["xs"] for r in propagate.step(n, state, 0.4).collect()} for n in (net, in_grid(net, 4))
    ]
    assert rows[0].keys() == rows[1].keys()
    assert all(rows[0][k] == pytest.approx(rows[1][k], rel=1e-12) for k in rows[0])


def test_edges_are_not_shuffled(spark, net, runs):
    grid = in_grid(net, 4)
    state = runs[0].nodes.select("scenario_id", "node", "xdem", "x0", "row_factor", "r")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with network.joined_by_block(spark):
            plans = [
                df._jdf.queryExecution().executedPlan().toString()
                for df in (
                    propagate.edge_flows(grid, state),
                    propagate.bottlenecks(grid, state),
                    required.pull(grid, state.select("scenario_id", "node", F.col("xdem").alias("v"))),
                )
            ]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan in plans:
        lines = plan.splitlines()
        at = next(k for k, line in enumerate(lines) if "shockweave_edges" in line)
        assert "SortMergeJoin" in plan and "SelectedBucketsCount" in lines[at]
        # What the scan feeds up to its join holds no exchange.
        depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
        for line in reversed(lines[:at]):
            inner = len(line) - len(line.lstrip(" :+-"))
            if inner < depth:
                depth = inner
                assert "Exchange" not in line, plan
                if "Join" in line:
                    break


def test_shocks_list_hits_only(spark, net):
    rows = [("a", ["BB"], ["P_1", "P_1"], None, None, None, None, 10.0, 0.0), ("b", None, None, None, None, ["CC"], [], 0.0, 7.0),
            ("c", ["ZZ"], None, None, None, None, None, 5.0, 5.0), ("d", None, None, None, None, None, None, 0.0, 0.0)]
    got = shocks.targeted_shocks(spark.createDataFrame(rows, shocks.SCENARIO_SCHEMA), net.nodes).collect()
    assert {(r["scenario_id"], r["label"], r["sd"], r["sp"]) for r in got} == {("a", "BB::P_1", 0.0, 0.1)} | {
        ("b", f"CC::{s}", 0.07, 0.0) for s in SECTORS
    }
    flat = spark.createDataFrame([("x", "AA", 0.2), ("y", "BB", 0.0), ("z", "??", 0.3)], "scenario_id string, ISO2 string, scalar double")
    assert shocks.flat_shocks(flat, net.nodes).count() == len(SECTORS)


def test_joins_of_a_run_pass_the_driver_by(spark, net, monkeypatch):
    key, step, seen = "spark.sql.autoBroadcastJoinThreshold", propagate.step, []
    monkeypatch.setattr(propagate, "step", lambda *a: seen.append(spark.conf.get(key)) or step(*a))
    before, scenarios = spark.conf.get(key), spark.createDataFrame(SCENARIOS[:2], shocks.SCENARIO_SCHEMA)
    stress.run(net, shocks.targeted_shocks(scenarios, net.nodes), max_iter=1, inner_rounds=1, scenarios=scenarios)
    assert seen == ["-1"] and spark.conf.get(key) == before


def test_few_edges_fill_many_tasks(net):
    grid = in_grid(net, 4)
    assert "out of 16" in grid.edges.groupBy("block").count()._jdf.queryExecution().toString()


def test_whole_vectors_have_every_node(spark, net):
    rows = [("a", ["BB"], ["P_1"], None, None, None, None, 10.0, 0.0), ("d", None, None, None, None, None, None, 0.0, 0.0)]
    scenarios = spark.createDataFrame(rows, shocks.SCENARIO_SCHEMA)
    got = shocks.whole_vectors(shocks.targeted_shocks(scenarios, net.nodes), scenarios, net.nodes).collect()
    assert sorted((r["scenario_id"], r["label"], r["sd"], r["sp"]) for r in got) == sorted(
        (s, label, 0.0, 0.1 if (s, label) == ("a", "BB::P_1") else 0.0) for s in ("a", "d") for label in LABELS
    )
    flat = spark.createDataFrame([("x", "AA", 0.2), ("y", "BB", 0.0), ("z", "??", 0.3)], "scenario_id string, ISO2 string, scalar double")
    got = shocks.whole_vectors(shocks.flat_shocks(flat, net.nodes), flat, net.nodes).collect()
    assert len(got) == 3 * N and {r["label"] for r in got if r["sp"] == 0.2} == {f"AA::{s}" for s in SECTORS}
    assert sum(r["sp"] > 0 for r in got) == len(SECTORS)


def test_pairs_of_a_hot_sector_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(propagate, "PAIRS_PER_TASK", 10)
    holders = [("s", 0, i, 0.05, 0.5) for i in range(20)] + [("s", 1, 100, 1.0, 0.5)]
    users = [("s", 0, j, float(j + 1)) for j in range(30)] + [("s", 1, 7, 2.0), ("t", 0, 8, 2.0)]
    stepped = spark.createDataFrame(holders, "scenario_id string, globsec int, node int, inv_share double, frac double")
    supply = spark.createDataFrame(users, "scenario_id string, globsec int, node int, delivered double")
    salts = {(r["scenario_id"], r["globsec"]): r["salts"] for r in propagate.pair_salts(stepped, supply).collect()}
    assert salts == {("s", 0): 30, ("s", 1): 1}
    got = propagate.reallocated_pairs(stepped, supply).collect()
    assert len(got) == 601 and len({(r["i"], r["j"]) for r in got}) == 601
    assert sum(r["added"] for r in got) == pytest.approx(sum(range(1, 31)) + 2.0)


def test_places_over_ranges(spark):
    rows = [(f"C{k % 7}", f"P_{k:03d}") for k in range(500)] + [("C3", f"Q_{k:03d}") for k in range(500)]
    df = spark.createDataFrame(rows, "country string, sector string").repartition(6)
    got = network.ranked(df, ["country", "sector"], "node").collect()
    assert [(r["country"], r["sector"]) for r in sorted(got, key=lambda r: r["node"])] == sorted(rows)
    assert sorted(r["node"] for r in got) == list(range(1000))
    assert network.ranked(df.limit(0), ["country", "sector"], "node").collect() == []


def test_tables_of_a_run_are_removed(spark, net, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path))
    scenarios = spark.createDataFrame(SCENARIOS[:2], shocks.SCENARIO_SCHEMA)
    vectors = shocks.targeted_shocks(scenarios, net.nodes)
    result = stress.run(net, vectors, gamma=0.4, max_iter=2, tol=1e-3, inner_rounds=3, return_history=True, scenarios=scenarios)
    iterations = result.gaps.select("iteration").distinct().count()
    assert len(list(tmp_path.iterdir())) == 2 + iterations  # final state, history and a gap table an iteration
    assert result.nodes.count() == 2 * N and result.history.count() > 0


def test_iterations_keep_their_compiled_classes(spark, net, monkeypatch):
    compiled = spark.sparkContext._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()
    step, seen = propagate.step, []
    monkeypatch.setattr(propagate, "step", lambda *a: seen.append(compiled.getCount()) or step(*a))
    scenarios = spark.createDataFrame(SCENARIOS[1:3], shocks.SCENARIO_SCHEMA)
    stress.run(
        net, shocks.targeted_shocks(scenarios, net.nodes), gamma=0.4, max_iter=5, tol=1e-15,
        scenarios=scenarios, requirements=required.total_requirements(net),
    )
    assert len(seen) == 5 and seen[4] - seen[3] <= 10


def test_scenarios_go_by_number_inside_a_run(spark, net, monkeypatch):
    step, kinds = propagate.step, []
    monkeypatch.setattr(propagate, "step", lambda n, state, g: kinds.append(dict(state.dtypes)["scenario_id"]) or step(n, state, g))
    hits = spark.createDataFrame(
        [("b", 0, 0.0, 0.2), ("a", 1, 0.1, 0.0), (None, 2, 0.0, 0.5), ("unlisted", 3, 0.0, 0.5)], "scenario_id string, node int, sd double, sp double"
    )
    listed = spark.createDataFrame([("b",), ("calm",), ("a",), (None,), ("b",)], "scenario_id string")
    result = stress.run(net, hits, gamma=0.4, max_iter=2, tol=1e-3, inner_rounds=3, return_history=True, scenarios=listed)
    assert kinds and set(kinds) == {"int"}
    rows = result.nodes.collect()
    assert {r["scenario_id"] for r in rows} == {"a", "b", "calm"} and len(rows) == 3 * N
    assert {(r["scenario_id"], r["node"]) for r in rows if r["sd"] or r["sp"]} == {("a", 1), ("b", 0)}
    for table in (result.gaps, result.history):
        assert {r["scenario_id"] for r in table.select("scenario_id").distinct().collect()} == {"a", "b", "calm"}
        assert "name" not in table.columns


def test_sums_hold_producers_and_users(spark):
    rows = [("s", 0, 2, 5, 10.0, 1.0, 0.1), ("s", 0, 3, 5, 20.0, 2.0, 0.2), ("s", 1, 2, 6, 5.0, 0.0, 0.3)]
    flows_ = spark.createDataFrame(rows, "scenario_id string, i int, j int, globsec int, base double, unmet double, t double")
    sums = propagate.edge_sums(flows_)
    got = {(r["globsec"], r["node"]): (r["base"], r["unmet"], r["ag"]) for r in propagate.inputs_by_sector(sums).collect()}
    assert got == {(5, 2): (10.0, 1.0, 0.1), (5, 3): (20.0, 2.0, 0.2), (6, 2): (5.0, 0.0, 0.3)}
    assert {r["node"]: r["base"] for r in sums.filter("globsec IS NULL").collect()} == {0: 30.0, 1: 5.0}
    balance = spark.createDataFrame([("s", 5, 0.5), ("s", 6, 1.0)], "scenario_id string, globsec int, frac double")
    nodes = {r["node"]: r for r in propagate.global_feasibility(propagate.sector_supply(sums, balance)).collect()}
    assert nodes[0]["base_row"] == 30.0 and nodes[0]["xg"] is None and nodes[0]["z_col"] is None
    assert nodes[2]["z_col"] == 15.5 and nodes[2]["xg"] == pytest.approx(5.0 / 0.3) and nodes[2]["base_row"] is None
