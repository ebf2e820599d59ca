"""Registered queries against their SQL. SHOCKWEAVE_ALL=1 checks every query."""

import os

import pytest

import __spark_entry__ as entry
from compare import check, duck
from shockweave.plans.registry import QUERIES

SF_DIR = os.environ.get("SHOCKWEAVE_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "latest_period_flows", "final_demand_output", "coefficient_check", "node_names", "cube_dispatch",
    "percentile_table", "targeted_shocks", "first_step_state", "feasible_state_k2", "country_impact",
    "links_combined", "heatmap_node", "map_table", "viewport_drop", "feasible_state_converged", "percentiles_kept",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("SHOCKWEAVE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem = check(spark, con, name, SF_DIR, entry.queries(), entry.oracle_sql())
    assert problem is None, problem


def test_every_query_has_sql():
    assert not set(QUERIES) - set(entry.oracle_sql())
