"""Every registered ensemble query against its SQL."""

import pytest

from rivulet import queries, views
from rivulet.operators import ranges
from rivulet.plans import reports
from tests.compare import assert_same, connected

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        assert_same(df, con.sql(queries.ORACLE_SQL[name]))
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["density_of_lowest_fifth", "density_report", "stage_profile"])
def test_tables_of_long_reports_are_derived_once(spark, name):
    assert not any("lineitem" in f for f in queries.QUERIES[name](spark, SF).inputFiles())


@pytest.mark.parametrize("report", [lambda *t: reports.density_report(*t, 20), reports.stage_profile])
def test_groups_are_dealt_to_as_many_tasks_as_their_rows_need(spark, monkeypatch, report):
    tables = views.stored(spark, SF)
    plan = lambda: report(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan()
    monkeypatch.setattr(ranges, "TASK_ROWS", 100)
    assert "REPARTITION_BY_NUM" in plan()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
