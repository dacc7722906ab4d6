"""Every catalogued query runs on whole tables; those with SQL give the rows that DuckDB gives."""

import pytest
from compare import SF, same

from framewright.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same(QUERIES[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 64
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_frame_queries_stay_within_rows(spark):
    """One frame's operators need no shuffle."""
    for name in ("bin_2x2", "contrast_scale", "lut_map", "align_shift", "gradient_hessian", "morph_open"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


def test_neighbours_meet_by_equality(spark):
    for name in ("pixel_band_join", "roi_adjacency", "event_frame_asof"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
