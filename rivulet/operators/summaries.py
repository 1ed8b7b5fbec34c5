"""Moment summaries, profiles and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.columns import ENSEMBLE, Cols
from rivulet.functions.numeric import finite, moments
from rivulet.operators.filters import suspicious


def overview(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """A1: rows, and distinct ids of each kind with their sorted lists (small dimensions)."""
    ids = [(cols.scenario, "scenario"), (cols.stage, "stage"), (cols.entity, "entity")]
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.sort_array(F.collect_set(c)).alias(f"{n}_ids") for c, n in ids]).select("rows", *[F.size(f"{n}_ids").alias(f"{n}_count") for _, n in ids], *[f"{n}_ids" for _, n in ids])


def moment_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A3: moments of the finite values of each group; one shuffle, combined on the map side."""
    return df.groupBy(*by).agg(*moments(finite(value)))


def monthly_summary(history: DataFrame, cols: Cols = ENSEMBLE, value: str = "value") -> DataFrame:
    """A4: moments of each (entity, calendar month); all twelve months of every entity."""
    per = moment_summary(history, [cols.entity, "month"], value)
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    every = history.select(cols.entity).distinct().select(cols.entity, months)
    return every.join(per, [cols.entity, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def stage_series(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A5: n, mean, sd, mean - sd and mean + sd of the finite values."""
    v = finite(value)
    per = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
    return per.withColumns({"low": F.col("mean") - F.col("sd"), "high": F.col("mean") + F.col("sd")})


def slack_means(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Mean finite slack of each (entity, stage)."""
    v = finite(cols.slack)
    return df.groupBy(*cols.group).agg(F.count(v).alias("n"), F.avg(v).alias("mean_slack"))


def with_group_mean(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """The group's mean slack beside each row with finite slack."""
    rows = df.filter(finite(cols.slack).isNotNull())
    return rows.join(slack_means(df, cols).drop("n"), cols.group)


def slice_indicators(slices: DataFrame) -> DataFrame:
    """For each percent and source, the range of selected counts, groups with data, and least and largest value."""
    return slices.groupBy("percent", "source").agg(F.min("k").alias("least_k"), F.max("k").alias("most_k"), F.sum(F.when(F.col("k") > 0, 1).otherwise(0)).alias("groups"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"))


def defined_counts(results: DataFrame, *by: str, number: str | None = None) -> DataFrame:
    """Defined, possible and undefined correlations; a row stands for as many as the column ``number`` says, or for one."""
    each = F.col(number) if number else F.lit(1).cast("long")
    per = results.groupBy(*by).agg(F.sum(F.when(F.col("reason") == "computed", each).otherwise(F.lit(0).cast("long"))).alias("defined"), F.sum(each).alias("possible"))
    return per.withColumn("undefined", F.col("possible") - F.col("defined"))


def evidence_counts(df: DataFrame, case: Column, cols: Cols = ENSEMBLE) -> DataFrame:
    """Rows of the case and suspicious rows."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return df.agg(count(case).alias("case_rows"), count(suspicious(cols)).alias("suspicious_rows"))


def pairs_expected(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Scenarios with any row in each stage."""
    return df.groupBy(cols.stage).agg(F.count_distinct(cols.scenario).alias("scenarios"))


def shape_by_stage(df: DataFrame, history: DataFrame, calendar: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Skewness and kurtosis by stage of both sources; history comes from the stage's calendar month."""
    from rivulet.operators.joins import small

    ours = moment_summary(df, cols.group, cols.value).select(*cols.group, F.lit("scenarios").alias("source"), "n", "skewness", "kurtosis")
    past = monthly_summary(history, cols)
    stages = df.select(*cols.group).distinct().join(small(calendar.select(cols.stage, "month")), cols.stage)
    projected = stages.join(past, [cols.entity, "month"], "left").select(*cols.group, F.lit("history").alias("source"), F.coalesce("n", F.lit(0)).alias("n"), "skewness", "kurtosis")
    # a series without any history is left out
    some = history.filter(finite("value").isNotNull()).select(cols.entity).distinct()
    return ours.unionByName(projected.join(some, cols.entity, "left_semi"))
