"""Projections and filters."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.columns import ENSEMBLE, Cols
from rivulet.functions.numeric import finite

LAG = re.compile(r"lag_(\d+)_m3s")
NEGATIVE = -0.01


def where(df: DataFrame, **equal) -> DataFrame:
    """conjunction of equalities; None means all."""
    conditions = [F.col(c) == v for c, v in equal.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def negative_flows(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """strictly below -0.01."""
    return df.filter(F.col(cols.value) < NEGATIVE)


def suspicious(cols: Cols = ENSEMBLE) -> Column:
    """positive flow beside positive slack."""
    return (F.col(cols.value) > 0) & (F.col(cols.slack) > 0)


def one_entity(df: DataFrame, entity: int, cols: Cols = ENSEMBLE) -> DataFrame:
    """one entity's rows by stage, scenario and node."""
    return df.filter(F.col(cols.entity) == entity).orderBy(cols.stage, cols.scenario, cols.node)


def slack_rows(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """F8: rows with finite slack."""
    return df.filter(finite(cols.slack).isNotNull())


def among(column: str, values: Iterable | None) -> Column:
    values = list(values or [])
    return F.col(column).isin(values) if values else F.lit(True)


def report_filter(report: DataFrame, entities=None, source: str | None = None, months=None, stages=None, windows=None, cols: Cols = ENSEMBLE) -> DataFrame:
    """months bind history rows only, stages scenario rows only; an empty list is all."""
    keep = among(cols.entity, entities) & among("window", windows)
    if source:
        keep &= F.col("source") == source
    keep &= (F.col("source") != "history") | among("month", months)
    keep &= (F.col("source") != "scenarios") | among(cols.stage, stages)
    return report.filter(keep)


def slice_filter(slices: DataFrame, percents=None, windows=None) -> DataFrame:
    """F10."""
    return slices.filter(among("percent", percents) & among("window", windows))


def both(table: DataFrame, detail: DataFrame, entities=None, period: str = "stage_id", periods=None, cols: Cols = ENSEMBLE) -> tuple[DataFrame, DataFrame]:
    """the same entities and periods (stages or years) of a table and of its diagnostics; an empty list is all."""
    keep = among(cols.entity, entities) & among(period, periods)
    return table.filter(keep), detail.filter(keep)


def unavailable(results: DataFrame) -> DataFrame:
    """results without a value."""
    return results.filter(F.col("reason") != "computed")


def lag_columns(columns: Iterable[str]) -> list[str]:
    """S3: lag columns by number."""
    return sorted((c for c in columns if LAG.fullmatch(c)), key=lambda c: int(LAG.fullmatch(c)[1]))


def ordered_columns(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """keys, value, slack, lags by number, the rest as they stand."""
    lead = [c for c in [*cols.key, cols.value, cols.slack] if c in df.columns]
    lags = lag_columns(df.columns)
    return df.select(*lead, *lags, *[c for c in df.columns if c not in lead and c not in lags])
