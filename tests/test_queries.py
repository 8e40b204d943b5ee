import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
SLOW = {"clean_recordings"}  # its plan is tested end to end in test_plans


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["dyad_id", "t", "gch_idx", "x"] and df.count() > 0


def test_every_counterpart_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(frame)
    if name in ORACLE:
        assert differences(frame, con.execute(ORACLE[name]).df()) == []


# The vector queries with one constant pairing are left out: there a join on the pairing is a join with one row.
@pytest.mark.parametrize("name", ["aligned_inputs", "mutual_align", "prepare_grid", "pad_and_zero_annotations", "role_labels", "remix_matrix", "bad_hf_noise", "class_distance", "side_variability"])
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
