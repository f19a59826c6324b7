"""Every registered query against its SQL on the smallest test tables, and the shape of plans."""

from pathlib import Path

import pytest

from __spark_entry__ import entry
from check import compare, connect
from flightloom.workload import all_oracles as oracle_sql
from flightloom.workload import all_queries as queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(str(DATA))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, name):
    said = compare(spark, con, name, queries()[name], oracle_sql().get(name), str(DATA))
    assert not said.startswith("FAIL"), said


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "distancia" in df.columns


@pytest.mark.parametrize(
    "name", ["track_summary", "training_features", "storm_exposure_flight", "points_in_polygon", "metar_parse", "synthetic_tracks"]
)
def test_plans_have_no_cartesian_product_and_no_python_rows(spark, name):
    plan = queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in plan
