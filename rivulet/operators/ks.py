"""Kolmogorov-Smirnov distance between scenarios and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.columns import ENSEMBLE, Cols
from rivulet.functions.labels import period_label
from rivulet.functions.numeric import finite
from rivulet.operators import ranges
from rivulet.operators.joins import small


def _samples(df: DataFrame, history: DataFrame, calendar: DataFrame, cols: Cols) -> DataFrame:
    """(entity, stage, month, x, c, h) row by row: scenarios and, for each stage with scenarios, the history of its month."""
    months = small(calendar.select(cols.stage, "month"))
    ours = df.select(*cols.group, finite(cols.value).alias("x"), F.lit(1).alias("c"), F.lit(0).alias("h")).join(months, cols.stage, "left")
    stages = df.select(*cols.group).distinct().join(months, cols.stage)
    past = stages.join(history.select(cols.entity, "month", finite("value").alias("x")), [cols.entity, "month"])
    return ours.unionByName(past.select(*cols.group, "month", "x", F.lit(0).alias("c"), F.lit(1).alias("h")))


def _curves(df: DataFrame, history: DataFrame, calendar: DataFrame, cols: Cols) -> DataFrame:
    """``_samples`` of groups that one task holds: scenario rows are shuffled once, by (entity, month), and the history of an
    (entity, month) is one array, which meets its stages there instead of being shuffled for each."""
    months = small(calendar.select(cols.stage, "month"))
    rows = df.select(*cols.group, finite(cols.value).alias("x")).join(months, cols.stage, "left").repartition(cols.entity, "month")
    ours = rows.groupBy(*cols.group, "month").agg(F.collect_list("x").alias("__xs"), F.count_if(F.col("x").isNull()).alias("__nil"))
    past = history.select(cols.entity, "month", finite("value").alias("x")).groupBy(cols.entity, "month", "x").agg(F.count(F.lit(1)).alias("h"))
    past = past.groupBy(cols.entity, "month").agg(F.collect_list(F.struct("x", "h")).alias("__past"))
    point = lambda x, c, h: F.struct(x.cast("double").alias("x"), c.cast("long").alias("c"), h.cast("long").alias("h"))
    found = [F.transform("__xs", lambda x: point(x, F.lit(1), F.lit(0))), F.array(point(F.lit(None), F.col("__nil"), F.lit(0)))]
    found.append(F.coalesce(F.transform("__past", lambda p: point(p["x"], F.lit(0), p["h"])), F.array().cast("array<struct<x:double,c:bigint,h:bigint>>")))
    return ours.join(past, [cols.entity, "month"], "left").select(*cols.group, "month", F.inline(F.concat(*found)))


def _sizes(df: DataFrame, history: DataFrame, calendar: DataFrame, cols: Cols) -> DataFrame:
    """(entity, stage, month, rows of both samples); no group has more points than rows."""
    ours = ranges.group_rows(df, cols.group).join(small(calendar.select(cols.stage, "month")), cols.stage)
    past = ranges.group_rows(history, [cols.entity, "month"]).withColumnRenamed("rows", "__past")
    both = ours.join(past, [cols.entity, "month"], "left")
    return both.select(*cols.group, "month", (F.col("rows") + F.coalesce("__past", F.lit(0))).alias("rows"))


def _points(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by, "x").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))


def _running(df: DataFrame, history: DataFrame, calendar: DataFrame, cols: Cols, large: int | None) -> DataFrame:
    """The points of each group, x null last, with running counts (cc, ch) and the finite rows of both samples (nc, nh).

    Points of groups with more than ``large`` rows are summed by ranges over many tasks.
    """
    by, sizes = [*cols.group, "month"], _sizes(df, history, calendar, cols)
    hot = None if large is None else ranges.large_groups(sizes, cols.group, large)
    rest, rows, past = df, None, history
    if hot is not None:
        rest, rows = ranges.parted(df, cols.group, hot)
        # a month that is large makes all its stages large, so no array need hold it
        past = history.join(ranges.parted(sizes, cols.group, hot)[0].select(cols.entity, "month").distinct(), [cols.entity, "month"], "left_semi")
    w = Window.partitionBy(*by)
    run = w.orderBy(F.col("x").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    valid = lambda c: F.sum(F.when(F.col("x").isNotNull(), F.col(c)).otherwise(0)).over(w)
    out = _points(_curves(rest, past, calendar, cols), by)
    out = out.withColumns({"cc": F.sum("c").over(run), "ch": F.sum("h").over(run), "nc": valid("c"), "nh": valid("h")})
    if hot is None:
        return out
    rows = _samples(rows, history, calendar, cols)
    found = ranges.running(_points(rows.filter("x is not null"), by), by, "x", ["c", "h"], hot, large)
    found = found.select(*by, "x", "c", "h", F.col("c_run").alias("cc"), F.col("h_run").alias("ch"), F.col("c_all").alias("nc"), F.col("h_all").alias("nh"))
    # rows without a finite value only count as found
    nil = _points(rows.filter("x is null"), by).select("*", *[F.lit(0).cast("long").alias(c) for c in ("cc", "ch", "nc", "nh")])
    return out.unionByName(found).unionByName(nil)


def ecdf(df: DataFrame, history: DataFrame, calendar: DataFrame, cols: Cols = ENSEMBLE, large: int | None = ranges.LARGE) -> DataFrame:
    """A10: for each distinct finite x of a group, cumulative counts and shares of both samples.

    Groups with more than ``large`` rows are held by no single task; None: the caller knows that there is none.
    """
    points = _running(df, history, calendar, cols, large).filter("x is not null")
    points = points.select(*cols.group, "x", F.col("cc").alias("cum_scenarios"), F.col("ch").alias("cum_history"), F.col("nc").alias("n_scenarios"), F.col("nh").alias("n_history"))
    return points.withColumns({"share_scenarios": F.try_divide("cum_scenarios", "n_scenarios"), "share_history": F.try_divide("cum_history", "n_history")})


def ks_distance(df: DataFrame, history: DataFrame, calendar: DataFrame, cols: Cols = ENSEMBLE, large: int | None = ranges.LARGE) -> DataFrame:
    """One row for each (entity, stage) with a scenario row.

    Distances are compared as integers, |cum_c n_h - cum_h n_c|, so ties are exact: the smallest x wins. ``large``: as in
    ``ecdf``.
    """
    # rows found and finite rows ride along with the points: x null has only the counts
    points = _running(df, history, calendar, cols, large)
    points = points.withColumn("num", F.when(F.col("x").isNotNull(), F.col("cc") * F.col("nh") - F.col("ch") * F.col("nc")))
    best = F.min_by(F.struct("x", "cc", "ch", "num"), F.when(F.col("x").isNotNull(), F.struct(-F.abs("num"), F.col("x"))))
    out = points.groupBy(*cols.group, "month").agg(F.sum("c").alias("found_scenarios"), F.sum("h").alias("found_history"), F.max("nc").alias("valid_scenarios"), F.max("nh").alias("valid_history"), best.alias("b"))
    nc, nh = F.col("valid_scenarios"), F.col("valid_history")
    situation = F.when(nc == 0, "no_scenarios").when(nh == 0, "no_history").when(F.least(nc, nh) == 1, "single_value").otherwise("computed")
    distance = F.when((nc > 0) & (nh > 0), F.abs("b.num") / (nc * nh))
    apart = distance > 0
    direction = F.when(apart & (F.col("b.num") > 0), "more_in_scenarios").when(apart, "more_in_history").when(distance == 0, "curves_coincide")
    out = out.withColumns({"situation": situation, "distance": distance, "distance_pp": distance * 100, "at_x": F.when(apart, F.col("b.x")), "count_scenarios": F.when(apart, F.col("b.cc")), "count_history": F.when(apart, F.col("b.ch")), "direction": direction})
    out = out.withColumns({"percent_scenarios": 100 * F.try_divide("count_scenarios", nc), "percent_history": 100 * F.try_divide("count_history", nh)}).drop("b", "month")
    return out.join(small(calendar.select(cols.stage, "order", period_label(F.col("start")).alias("period"))), cols.stage)
