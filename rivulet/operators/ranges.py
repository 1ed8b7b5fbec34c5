"""Ranks and running sums of groups too large for one task.

A window orders a whole group in one task. Groups with more than ``LARGE`` rows are instead dealt by ranges of (group,
order) and stored; one row for each range says what lies before it, and is added to the places inside the range.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.sources.writers import scratch

#: Rows of a group that one window orders at most.
LARGE = 1_000_000
#: Rows of a task that ranks groups, about.
TASK_ROWS = 250_000
#: Ranges that a group of that size falls into, and the most ranges of all groups; beyond those, ranges hold more rows and
#: are sorted with spilling.
RANGES, MOST_RANGES = 4, 10_000
#: Groups that are split at most, the largest first: any other has less than one in as many of all rows.
MOST_GROUPS = 10_000


def large_groups(counts: DataFrame, by: list[str], large: int = LARGE) -> DataFrame | None:
    """(by, ``rows``) of the groups with more than ``large`` rows by ``counts`` (by, rows), or None if there is none."""
    held = counts.filter(F.col("rows") > large).orderBy(F.desc("rows")).limit(MOST_GROUPS).select(*by, F.col("rows").cast("long"))
    found = held.toArrow()
    return counts.sparkSession.createDataFrame(found, held.schema) if found.num_rows else None


def group_rows(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def spread(df: DataFrame, by: list[str], rows: int | None) -> DataFrame:
    """``df`` of about ``rows`` rows, dealt by group to tasks of about ``TASK_ROWS``; unchanged if a shuffle's usual number
    of partitions will do, or as many as there are cores, to which re-planning may join them, or where ``rows`` is not known."""
    parts = math.ceil((rows or 0) / TASK_ROWS)
    usual = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(min(MOST_RANGES, parts), *by) if parts > usual else df


def _same(right: DataFrame, by: list[str]) -> tuple[DataFrame, Column]:
    """``right`` under other names, broadcast, and the condition that its keys are those of the left side, nulls included."""
    named = right.select(*[F.col(c).alias(f"__r_{c}" if c in by else c) for c in right.columns])
    return F.broadcast(named), reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in by])


def parted(df: DataFrame, by: list[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other groups, rows of the groups of ``hot``)."""
    right, same = _same(hot.select(*by), by)
    return df.join(right, same, "left_anti"), df.join(right, same, "left_semi")


def joined(df: DataFrame, by: list[str], right: DataFrame) -> DataFrame:
    """``df`` with the columns of ``right``, a table of no more rows than groups and ranges, which is broadcast."""
    right, same = _same(right, by)
    return df.join(right, same).drop(*[f"__r_{k}" for k in by])


def stored_ranges(df: DataFrame, by: list[str], order: list[str], hot: DataFrame, large: int) -> DataFrame:
    """``df``, the rows of ``hot``, sorted in ranges of (by, order), with the number of the range and the place in it.

    It is written once: a second run of the range shuffle would sample other bounds.
    """
    keys, rows = [*by, *order], hot.agg(F.sum("rows")).first()[0]
    ranged = df.repartitionByRange(min(MOST_RANGES, math.ceil(rows * RANGES / max(RANGES, large))), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    out = ranged.select("*", F.shiftright(at, 33).alias("__range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))
    return scratch(out)


def _before(parts: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Adds to one row for each (by, range) what lies in the group's earlier ranges, and in the whole group."""
    whole = Window.partitionBy(*by)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums], *[F.sum(c).over(whole).alias(f"{c}_all") for c in sums])


def numbered(df: DataFrame, by: list[str], order: list[str], hot: DataFrame, large: int = LARGE) -> DataFrame:
    """W6 of large groups: ``df`` with the rank ``rn`` from 1 in its group and the size ``n`` of the group.

    Rows are shuffled once; ranks come from their places.
    """
    rows = stored_ranges(df, by, order, hot, large)
    parts = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__c"), F.min("__place").alias("__least"))
    parts = _before(parts, by, ["__c"]).select(*by, "__range", (F.col("__c_before") - F.col("__least") + 1).alias("__shift"), F.col("__c_all").alias("n"))
    out = joined(rows, [*by, "__range"], parts)
    return out.select(*df.columns, (F.col("__place") + F.col("__shift")).alias("rn"), "n")


def running(df: DataFrame, by: list[str], order: str, sums: list[str], hot: DataFrame, large: int = LARGE) -> DataFrame:
    """W7 of large groups, whose ``order`` is distinct: ``df`` with ``<c>_run``, the sum up to the row, and ``<c>_all``.

    Sums run inside a range, and the sums of the ranges before it are added.
    """
    rows = stored_ranges(df, by, [order], hot, large).drop("__place")
    parts = _before(rows.groupBy(*by, "__range").agg(*[F.sum(c).alias(c) for c in sums]), by, sums).drop(*sums)
    inside = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined(rows.select("*", *[F.sum(c).over(inside).alias(f"__{c}") for c in sums]), [*by, "__range"], parts)
    return out.select(*df.columns, *[(F.col(f"__{c}") + F.col(f"{c}_before")).alias(f"{c}_run") for c in sums], *[f"{c}_all" for c in sums])

