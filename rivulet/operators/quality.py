"""Data quality: every rule returns its violations; ``require`` raises if there are any (Q1-Q20)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.columns import ENSEMBLE, Cols
from rivulet.functions.labels import next_month
from rivulet.functions.numeric import finite, to_date, to_double


#: Violations that an error names.
SHOWN = 20


class QualityError(ValueError):
    """A rule is violated."""


def require(violations: DataFrame, rule: str) -> None:
    """Raises with ``SHOWN`` examples if there is any violation."""
    found = [r.asDict() for r in violations.limit(SHOWN + 1).collect()]
    if found:
        more = ", and more" if len(found) > SHOWN else ""
        raise QualityError(f"{rule}: {', '.join(map(str, found[:SHOWN]))}{more}")


def wrong_path_ids(tree: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Q1: the stored scenario differs from that of the path, which is null if the path has none."""
    return tree.filter(~F.col(cols.scenario).eqNullSafe(F.col("path_scenario_id"))).select("path_scenario_id", cols.scenario).distinct()


def null_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Q2: the number of nulls of each key that has any."""
    keys = list(keys)
    counts = df.agg(*[F.sum(F.when(F.col(k).isNull(), 1).otherwise(0)).alias(k) for k in keys])
    return counts.unpivot([], keys, "key", "nulls").filter("nulls > 0")


def duplicates(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Q3: keys with several rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def only_in_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of one source only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    side = lambda x, y, name: x.join(y, key, "left_anti").select(key, F.lit(name).alias("only_in"))
    return side(a, b, "left").unionByName(side(b, a, "right"))


def bad_folders(manifest: DataFrame) -> DataFrame:
    """Q1, Q2, Q4 over ``readers.tree_manifest``: (folder, problem)."""
    same = F.count("scenario").over(Window.partitionBy("scenario"))
    problem = (
        F.when(~F.col("is_folder"), "not_a_folder")
        .when(F.col("scenario").isNull(), "no_number")
        .when(same > 1, "repeated_scenario")
        .when(F.col("bytes").isNull(), "no_file")
        .when(F.col("rows") == 0, "empty_file")
        .when(F.col("nulls") > 0, "null_scenario")
        .when((F.col("least") != F.col("scenario")) | (F.col("most") != F.col("scenario")), "other_scenario")
    )
    return manifest.select("folder", problem.alias("problem")).filter("problem is not null")


def several_files(tree: DataFrame) -> DataFrame:
    """Q4: scenario numbers that several folders (1 and 01) stand for."""
    return tree.select("path_scenario_id", "file_path").distinct().groupBy("path_scenario_id").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def missing_columns(df: DataFrame, needed: Iterable[str]) -> list[str]:
    """Q9: metadata only."""
    return [c for c in needed if c not in df.columns]


def require_columns(df: DataFrame, needed: Iterable[str]) -> None:
    if gone := missing_columns(df, needed):
        raise QualityError(f"missing columns {gone}; found {df.columns}")


def orphans(child: DataFrame, parent: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys of ``child`` without a row in ``parent``."""
    keys = list(keys)
    return child.select(*keys).distinct().join(parent.select(*keys), keys, "left_anti")


def bad_catalog(names: DataFrame, entity: str = "hydro_id") -> DataFrame:
    """Q11: null or repeated id, blank name."""
    n = F.count(F.lit(1)).over(Window.partitionBy(entity))
    problem = F.when(F.col(entity).isNull(), "null_id").when(n > 1, "repeated_id").when(F.coalesce(F.trim("name"), F.lit("")) == "", "blank_name")
    return names.withColumn("problem", problem).filter("problem is not null")


def bad_calendar(calendar: DataFrame, stage: str = "stage_id") -> DataFrame:
    """Q12: ids, whole months, and no gap or overlap between consecutive stages (a small table: one window orders it)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(stage))
    after = F.lead("start").over(Window.orderBy("start"))
    problem = (
        F.when(F.col(stage).isNull(), "null_id")
        .when(n > 1, "repeated_id")
        .when(F.col("start").isNull() | F.col("end").isNull(), "bad_date")
        .when((F.trunc("start", "MM") != F.col("start")) | (next_month(F.col("start")) != F.col("end")), "not_a_month")
        .when(after != F.col("end"), "gap_or_overlap")
    )
    return calendar.withColumn("problem", problem).filter("problem is not null")


def unknown_stages(df: DataFrame, calendar: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Q13: stages in the data but not in the calendar."""
    return df.select(cols.stage).distinct().join(calendar.select(cols.stage), cols.stage, "left_anti")


def unnamed_entities(df: DataFrame, names: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Q14: entities in the data without a name."""
    return df.select(cols.entity).distinct().join(names.filter(F.trim("name") != "").select(cols.entity), cols.entity, "left_anti")


def bad_history(history: DataFrame, cols: Cols = ENSEMBLE, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Q15: dates that cannot be read, that are not whole months, or a month twice for one entity."""
    a, b = to_date(start), to_date(end)
    n = F.count(F.lit(1)).over(Window.partitionBy(cols.entity, F.trunc(a, "MM")))
    problem = F.when(a.isNull() | b.isNull(), "bad_date").when((F.trunc(a, "MM") != a) | (next_month(a) != b), "not_a_month").when(n > 1, "repeated_month")
    return history.withColumn("problem", problem).filter("problem is not null")


def bad_groups(df: DataFrame, cols: Cols = ENSEMBLE, calendar: DataFrame | None = None) -> DataFrame:
    """Q16: (entity, stage) where rows, distinct scenarios and non-null nodes (if there is such a column) differ; with a
    calendar also those of a stage that it lacks (Q13), as ``unknown``: one aggregate for both rules."""
    from rivulet.operators.joins import small

    nodes = [F.count(cols.node).alias("nodes")] if cols.node in df.columns else []
    counts = df.groupBy(*cols.group).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(cols.scenario).alias("scenarios"), *nodes)
    wrong = F.col("rows") != F.col("scenarios")
    wrong = wrong | (F.col("rows") != F.col("nodes")) if nodes else wrong
    if calendar is not None:
        counts = counts.join(small(calendar.select(cols.stage, F.lit(False).alias("unknown"))), cols.stage, "left").withColumn("unknown", F.coalesce("unknown", F.lit(True)))
        wrong = wrong | F.col("unknown")
    return counts.filter(wrong)


def bad_years(df: DataFrame, calendar: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """(entity, scenario, year) where rows, distinct stages and non-null nodes differ; the year is null for stages
    that the calendar lacks, all of which are wrong."""
    from rivulet.operators.joins import small

    dated = df.join(small(calendar.select(cols.stage, "year")), cols.stage, "left")
    counts = dated.groupBy(cols.entity, cols.scenario, "year").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(cols.stage).alias("stages"), F.count(cols.node).alias("nodes"))
    return counts.filter("rows <> stages or rows <> nodes or year is null")


def scenario_counts(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Q18: scenarios of each (entity, stage), with the entity's least and most."""
    per = df.groupBy(*cols.group).agg(F.count_distinct(cols.scenario).alias("scenarios"))
    w = Window.partitionBy(cols.entity)
    return per.withColumns({"least": F.min("scenarios").over(w), "most": F.max("scenarios").over(w)})


def missing_values(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Q19: values of each entity that are null or not finite."""
    return df.groupBy(cols.entity).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(finite(to_double(cols.value)).isNull(), 1).otherwise(0)).alias("missing"))


def months_without_history(df: DataFrame, calendar: DataFrame, history: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Q20: (entity, calendar month) that the stages need and the history lacks."""
    from rivulet.operators.joins import small

    needed = df.select(*cols.group).distinct().join(small(calendar.select(cols.stage, "month")), cols.stage).select(cols.entity, "month").distinct()
    held = history.select(cols.entity, F.month("start").alias("month")).distinct()
    return needed.join(held, [cols.entity, "month"], "left_anti")
