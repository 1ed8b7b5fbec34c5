"""Shuffles of full rows in the plans, counted without broadcast and re-planning."""

import datetime
import re

import pytest

from rivulet.operators import consolidate, correlation, ks, ranges, slices, summaries, windows
from rivulet.sources import readers, writers
from rivulet.sources.readers import with_order

FLOWS = "scenario_id long, stage_id long, node_id long, hydro_id long, incremental_inflow_m3s double"


@pytest.fixture
def plain(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    fresh = [x for x in plan.splitlines() if "ReusedExchange" not in x]
    return sum(bool(re.search(r"Exchange (?:hash|range)partitioning", x)) for x in fresh), "\n".join(fresh)


def ensemble(spark, more=""):
    return spark.createDataFrame([], FLOWS + more)


def calendar(spark):
    return with_order(spark.createDataFrame([(0, datetime.date(2026, 1, 1), datetime.date(2026, 2, 1))], "stage_id long, start date, end date"))


def history(spark):
    return spark.createDataFrame([], "hydro_id long, start date, end date, value double, month int")


def test_moments_need_one_shuffle(plain):
    n, plan = exchanges(summaries.moment_summary(ensemble(plain), ["hydro_id", "stage_id"], "incremental_inflow_m3s"))
    assert n == 1 and "partial_skewness" in plan


def test_both_window_sizes_share_one_shuffle_and_sort(plain):
    n, plan = exchanges(windows.rolling_sums(ensemble(plain), calendar(plain)))
    assert n == 1 and "BroadcastHashJoin" in plan


def test_audit_needs_one_shuffle_of_rows_and_one_of_counts(plain):
    lags = "".join(f", lag_{k}_m3s double" for k in range(1, 7))
    assert exchanges(windows.lag_audit(ensemble(plain, lags), calendar(plain)))[0] == 2


def test_lag_correlation_shuffles_rows_once(plain):
    lags = "".join(f", lag_{k}_m3s double" for k in range(1, 7))
    # moments, counts of keys and the audit are one aggregate over the rows, which an entity's task holds
    n, plan = exchanges(correlation.lag_correlation(ensemble(plain, lags), calendar(plain)))
    assert n == 1 and plan.count("Generate explode") == 1


def test_lags_of_many_rows_are_dealt_to_more_tasks(plain, monkeypatch):
    monkeypatch.setattr(ranges, "TASK_ROWS", 10)
    rows = [(c, 0, c, e, float(c), None) for c in range(5) for e in range(4)]
    df = plain.createDataFrame(rows, FLOWS + ", lag_1_m3s double")
    whole = correlation.lag_correlation(df, calendar(plain))
    # 20 rows, each of which becomes two
    assert whole.rdd.getNumPartitions() == 4 and whole.count() == 8
    monkeypatch.setattr(ranges, "TASK_ROWS", 5)
    assert correlation.lag_correlation(df, calendar(plain)).rdd.getNumPartitions() == 8
    monkeypatch.setattr(ranges, "LARGE", 4)
    # entities beyond one task are dealt by scenario too, with the same figures
    order = lambda t: sorted(map(str, t.collect()))
    assert order(correlation.lag_correlation(df, calendar(plain))) == order(whole)


def test_slices_rank_once(plain):
    assert exchanges(slices.slices(ensemble(plain), ["hydro_id", "stage_id"], "incremental_inflow_m3s", "scenario_id"))[0] == 1


def test_consolidation_shuffles_each_tree_once(plain):
    flows = ensemble(plain, ", block_id int, inflow_nonnegativity_slack_m3s double")
    lags = plain.createDataFrame([(1, 1, 1, 1, 1, 1.0)], "scenario_id long, stage_id long, node_id long, hydro_id long, lag_index int, inflow_m3s double")
    # one for each tree, of partial aggregates that the join reuses
    assert exchanges(consolidate.consolidate(flows, lags, checked=False))[0] == 2


def test_checked_consolidation_reads_flows_once_and_lags_twice(spark):
    read = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def tree(rows, schema, seen):
        return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda r: (seen.add(1), r)[1]), schema)

    keys = "scenario_id long, stage_id long, node_id long, hydro_id long, "
    flows = tree([(c, s, s, 1, b, 1.0 * s, 0.0) for c in range(2) for s in range(3) for b in (0, 1)], keys + "block_id int, incremental_inflow_m3s double, inflow_nonnegativity_slack_m3s double", read[0])
    lags = tree([(c, s, s, 1, 1, 5.0) for c in range(2) for s in range(3)], keys + "lag_index int, inflow_m3s double", read[1])
    assert consolidate.consolidate(flows, lags).count() == 6
    assert [r.value for r in read] == [12, 12]


def test_ks_shuffles_rows_once_and_history_as_arrays(plain):
    n, plan = exchanges(ks.ks_distance(ensemble(plain), history(plain), calendar(plain), large=None))
    # the rows, the values of history, and its arrays
    assert n == 3 and plan.count("Generate inline") == 1 and plan.count("hashpartitioning(hydro_id") == 3


def test_annual_sums_need_one_shuffle(plain):
    assert exchanges(correlation.annual_sums(ensemble(plain), calendar(plain)))[0] <= 2


def test_annual_correlation(plain):
    # sums and window 3 (with the distinct stages), pairs 1, scenarios of an entity 2, and the grid's join
    assert exchanges(correlation.annual_correlation(ensemble(plain), calendar(plain)))[0] <= 6


def test_spatial_correlation(plain):
    n, plan = exchanges(correlation.spatial_correlation(ensemble(plain)))
    assert n <= 8 and "CartesianProduct" not in plan


@pytest.mark.parametrize("form", [correlation.spatial_correlation, correlation.spatial_pairs])
def test_pairs_are_not_shuffled(plain, form):
    """A task finishes its pairs: the last exchange is that of packed rows, also where each pair is taken both ways."""
    for df in (form(ensemble(plain)), correlation.mirrored(form(ensemble(plain)))):
        _, plan = exchanges(df)
        assert plan.count("Exchange hashpartitioning(stage") <= 1 and plan.count("MapInArrow") == 2
        assert plan.index("MapInArrow summed") < plan.index("Exchange")


def test_report_checks_are_one_aggregate(plain):
    from rivulet.operators import quality

    assert exchanges(quality.bad_groups(ensemble(plain), calendar=calendar(plain)))[0] == 2


def test_scan_reads_only_needed_columns(plain):
    from rivulet import queries

    _, plan = exchanges(queries.QUERIES["A6_slack_means"](plain, "/root/testdata/sf0.001"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert "l_comment" not in schema and len(schema.split(",")) <= 5


def test_slices_repeat_no_row_before_their_first_aggregate(plain):
    out = slices._slice_stats(slices.ranked(ensemble(plain), ["hydro_id", "stage_id"], "incremental_inflow_m3s", "scenario_id"), ["hydro_id", "stage_id"], slices.PERCENTS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.index("Generate explode") < plan.index("Window")


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    """One dataset by stage, one by scenario, and their rows; the group (1, 0), and the series (1, 0), are stored apart."""
    rows = [(s, t, t * 10 + s, e, float((s * 7 + t * 3 + e) % 11)) for s in range(30) for t in range(12) for e in (1, 2, 3)]
    rows += [(s, 0, s, 1, float(s % 5)) for s in range(30, 90)]
    df = spark.createDataFrame(rows, FLOWS)
    folder = tmp_path_factory.mktemp("buckets")
    for by, large in (("stage", 80), ("scenario", 1000)):
        writers.publish_buckets(df, f"{folder}/{by}", by, 5, large)
    return folder, df


def months(spark):
    return with_order(spark.createDataFrame([(i, datetime.date(2026 + i // 12, i % 12 + 1, 1), datetime.date(2026 + (i + 1) // 12, (i + 1) % 12 + 1, 1)) for i in range(12)], "stage_id long, start date, end date"))


JOBS = {
    "moments": ("stage", lambda df: summaries.moment_summary(df, ["hydro_id", "stage_id"], "incremental_inflow_m3s")),
    "slices": ("stage", lambda df: slices.slices(df, ["hydro_id", "stage_id"], "incremental_inflow_m3s", "scenario_id")),
    "windows": ("scenario", lambda df: windows.rolling_sums(df, months(df.sparkSession))),
}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_bucketed_groups_need_no_shuffle(plain, bucketed, name):
    folder, df = bucketed
    by, job = JOBS[name]
    rows, large = readers.read_buckets(plain, f"{folder}/{by}")
    assert exchanges(job(rows))[0] == 0 and (large is None) == (by == "scenario")
    tidy = lambda out: sorted(str([round(x, 9) + 0.0 if isinstance(x, float) else x for x in r]) for r in out.collect())
    assert tidy(readers.over_groups(plain, f"{folder}/{by}", job)) == tidy(job(df))


def test_buckets_are_one_file_each_and_keep_every_row(spark, bucketed):
    folder, df = bucketed
    rows, large = readers.read_buckets(spark, f"{folder}/stage")
    assert len(rows.inputFiles()) <= 5 and large.select("hydro_id", "stage_id").distinct().collect() == [(1, 0)]
    assert sorted(rows.unionByName(large).collect()) == sorted(df.collect()) and rows.columns == df.columns


def test_buckets_are_replaced_and_may_be_empty(spark, bucketed, tmp_path):
    _, df = bucketed
    for rows, buckets in ((df, 3), (df.limit(0), 4), (df.filter("hydro_id = 2"), 2)):
        writers.publish_buckets(rows, f"{tmp_path}/b", "stage", buckets)
        got, large = readers.read_buckets(spark, f"{tmp_path}/b")
        assert large is None and sorted(got.collect()) == sorted(rows.collect())
