"""Ordered pages and lowest records."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.columns import ENSEMBLE, Cols


def page_order(column: str, descending: bool, cols: Cols = ENSEMBLE) -> list[Column]:
    """Nulls last either way, then the keys."""
    first = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return [first, *[F.col(k) for k in cols.key if k != column]]


def page(df: DataFrame, column: str, descending: bool = False, number: int = 1, size: int = 100, cols: Cols = ENSEMBLE) -> DataFrame:
    """Page ``number`` from 1; near pages are a top-k, not a full sort."""
    return df.orderBy(*page_order(column, descending, cols)).offset((number - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))


def page_after(df: DataFrame, column: str, last: dict, descending: bool = False, size: int = 100, cols: Cols = ENSEMBLE) -> DataFrame:
    """T1 for deep pages: the rows after ``last``, a row's values of the order columns; cost doesn't grow with depth."""
    value = last[column]
    c = F.col(column)
    if value is None:
        beyond, same = F.lit(False), c.isNull()
    else:
        beyond, same = ((c < value) if descending else (c > value)) | c.isNull(), c == value
    rest = [k for k in cols.key if k != column]
    steps = [reduce(lambda x, y: x & y, [F.col(k) == last[k] for k in rest[:i]], same) & (F.col(rest[i]) > last[rest[i]]) for i in range(len(rest))]
    return df.filter(reduce(lambda x, y: x | y, steps, beyond)).orderBy(*page_order(column, descending, cols)).limit(size)


def stored_page(spark: SparkSession, path: str, column: str, descending: bool = False, number: int = 1, size: int = 100, cols: Cols = ENSEMBLE) -> DataFrame:
    """T1 at any depth from what ``writers.publish_pages`` wrote in the same order: reads the ranges that hold the page.

    No range is empty, so a page lies in ``size`` of them at most; numbers beyond the last page give no rows.
    """
    start = (number - 1) * size
    held = spark.read.parquet(f"{path}/directory").filter((F.col("first") < start + size) & (F.col("first") + F.col("rows") > start))
    parts = {r["page_part"]: r["first"] for r in held.limit(size).collect()}
    schema = spark.read.parquet(f"{path}/schema").schema
    rows = spark.read.schema(schema.add("page_part", "integer")).parquet(f"{path}/rows").filter(F.col("page_part").isin(list(parts)))
    return rows.drop("page_part").orderBy(*page_order(column, descending, cols)).offset(start - min(parts.values(), default=start)).limit(size)


def lowest_record(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """The row with the lowest value; ties by scenario, stage, node, entity."""
    return df.filter(F.col(cols.value).isNotNull() & ~F.isnan(cols.value)).orderBy(cols.value, *cols.key).limit(1)
