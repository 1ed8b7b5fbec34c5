"""Groups split by ranges against the window form, and their plans."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import ks, ranges, slices
from rivulet.sources.readers import with_order

SCHEMA = "hydro_id long, stage_id long, scenario_id long, v double"


@pytest.fixture(scope="module")
def rows(spark):
    """Two large groups, one of which repeats few values, and small ones; nulls, infinities and NaN among them."""
    rnd, out = random.Random(7), []
    for entity, stage, n, step in ((1, 0, 900, 0.001), (2, 1, 700, 25.0), (3, 0, 40, 0.1), (3, 1, 1, 1.0)):
        for i in range(n):
            v = round(rnd.lognormvariate(3, 1.2) / step) * step
            out.append((entity, stage, i, None if i % 31 == 30 else math.inf if i % 37 == 36 else math.nan if i % 41 == 40 else v))
    out += [(4, 1, i, None) for i in range(50)]
    rnd.shuffle(out)
    return spark.createDataFrame(out, SCHEMA).repartition(5).cache()


def found(df):
    """Rows with floats to nine digits."""
    def plain(x):
        if isinstance(x, list):
            return tuple(plain(y) for y in x)
        return float(f"{x:.9g}") + 0.0 if isinstance(x, float) else x

    return sorted((tuple(plain(r[c]) for c in df.columns) for r in df.collect()), key=repr)


BY = ["hydro_id", "stage_id"]


def test_ranks_equal_the_window(rows):
    split = slices.ranked(rows, BY, "v", "scenario_id", large=100)
    assert found(split) == found(slices.ranked(rows, BY, "v", "scenario_id", large=None))


@pytest.mark.parametrize("percents, keep", [(slices.PERCENTS, False), ((100,), True), ((30, 7), True)])
def test_slices_equal_the_window(rows, percents, keep):
    split = slices.slices(rows, BY, "v", "scenario_id", percents, keep, empty=True, large=100)
    assert found(split) == found(slices.slices(rows, BY, "v", "scenario_id", percents, keep, empty=True, large=None))


def test_lowest_slice_of_equal_values_takes_ties_in_order(spark):
    df = spark.range(300).select(F.lit(1).cast("long").alias("hydro_id"), F.lit(1).cast("long").alias("stage_id"), F.col("id").alias("scenario_id"), F.lit(5.0).alias("v"))
    split = slices.lowest(df, BY, "v", "scenario_id", 10, large=100)
    assert sorted(r["scenario_id"] for r in split.collect()) == list(range(30))


def test_only_groups_beyond_the_size_are_split(rows):
    hot = ranges.large_groups(ranges.group_rows(rows, BY), BY, 699)
    assert sorted((r["hydro_id"], r["rows"]) for r in hot.collect()) == [(1, 900), (2, 700)]
    assert ranges.large_groups(ranges.group_rows(rows, BY), BY, 900) is None
    rest, split = ranges.parted(rows, BY, hot)
    assert rest.count() == 91 and split.count() == 1600


def test_null_keys_are_a_group_of_their_own(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.lit(1)).cast("long").alias("k"), "id", (F.col("id") % 7).cast("double").alias("v"))
    out = slices.ranked(df, ["k"], "v", "id", large=100)
    assert found(out) == found(slices.ranked(df, ["k"], "v", "id", large=None))
    assert {(r["k"], r["n"]) for r in out.collect()} == {(1, 200), (None, 200)}


def test_a_large_group_lies_in_many_ranges(rows):
    hot = ranges.large_groups(ranges.group_rows(rows, BY), BY, 100)
    stored = ranges.stored_ranges(ranges.parted(rows.filter("v is not null"), BY, hot)[1], BY, ["v", "scenario_id"], hot, 200)
    sizes = [r["count"] for r in stored.groupBy(*BY, "__range").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 200


def tables(spark, rows):
    df = rows.withColumn("node_id", F.col("stage_id")).withColumnRenamed("v", "incremental_inflow_m3s")
    dates = [datetime.date(2026, m, 1) for m in (1, 2, 3)]
    cal = with_order(spark.createDataFrame([(i, dates[i], dates[i + 1]) for i in range(2)], "stage_id long, start date, end date"))
    rnd = random.Random(9)
    past = [(e, datetime.date(1900 + y, m, 1), None if y % 19 == 0 else round(rnd.lognormvariate(3, 1) / 5) * 5.0, m) for e in (1, 2, 3) for m in (1, 2) for y in range(60) if (e, m) != (3, 2)]
    return df, spark.createDataFrame(past, "hydro_id long, start date, value double, month int"), cal


@pytest.mark.parametrize("large", [100, 45])
def test_curves_and_distances_equal_the_window(spark, rows, large):
    df, history, cal = tables(spark, rows)
    for job in (ks.ecdf, ks.ks_distance):
        assert found(job(df, history, cal, large=large)) == found(job(df, history, cal, large=None))


def test_large_groups_beyond_the_most_that_are_split_keep_their_history(spark, rows, monkeypatch):
    df, history, cal = tables(spark, rows)
    monkeypatch.setattr(ranges, "MOST_GROUPS", 1)
    assert found(ks.ks_distance(df, history, cal, large=45)) == found(ks.ks_distance(df, history, cal, large=None))


def test_large_history_is_split_too(spark):
    df, history, cal = tables(spark, spark.createDataFrame([(1, 0, 1, 20.0), (1, 0, 2, 30.0)], SCHEMA))
    past = history.filter("hydro_id = 1 and month = 1").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("again")
    assert ks._sizes(df, past, cal, ks.ENSEMBLE).first()["rows"] == 302
    assert found(ks.ks_distance(df, past, cal, large=200)) == found(ks.ks_distance(df, past, cal, large=None))


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert slices.slices(df, BY, "v", "scenario_id", large=0).count() == 0


def test_tasks_get_no_more_rows_as_tables_grow(spark, monkeypatch):
    """Groups are dealt to as many tasks as their rows need, and the slices stay the same."""
    monkeypatch.setattr(ranges, "TASK_ROWS", 100)
    df = spark.range(2000).selectExpr("id % 40 as g", "id as tie", "cast((id * 7919) % 977 as double) as v")
    plain, dealt = (slices.slices(df, ["g"], "v", "tie", (10, 50, 100), large=None, rows=n) for n in (None, 2000))
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString() and ranges.spread(df, ["g"], 2000).rdd.getNumPartitions() == 20
    assert ranges.spread(df, ["g"], 300) is df and ranges.spread(df, ["g"], None) is df
    key = lambda r: (r["g"], r["percent"])
    assert sorted(dealt.collect(), key=key) == sorted(plain.collect(), key=key)
