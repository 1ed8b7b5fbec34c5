"""Consolidation of the two scenario trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rivulet.columns import ENSEMBLE, Cols
from rivulet.operators import filters, quality
from rivulet.operators.joins import small
from rivulet.sources.writers import replace, scratch

LAG_VALUE = "inflow_m3s"


def _by_key(flows: DataFrame, cols: Cols) -> DataFrame:
    """One row for each key with both flows that ``_chosen`` chooses from, and counts for the block rules."""
    block, v = F.col("block_id"), F.col(cols.value)
    return flows.groupBy(*cols.key).agg(
        F.count(F.lit(1)).alias("flow_rows"),
        F.sum(F.when(block.isNull(), 1).otherwise(0)).alias("whole_rows"),
        F.sum(F.when(block == 0, 1).otherwise(0)).alias("zero_rows"),
        F.max(F.when(block.isNull(), v)).alias("whole"),
        F.max(F.when(block == 0, v)).alias("zero"),
        F.max(F.when(block == 0, F.col(cols.slack))).alias(cols.slack),
        ((F.min(v) != F.max(v)) | ((F.count(v) > 0) & (F.count(v) < F.count(F.lit(1))))).alias("different"),
    )


def _chosen(per: DataFrame, whole: DataFrame, cols: Cols) -> DataFrame:
    """The choice is made for each scenario, of which there are few; ``whole`` has rows of those with null blocks."""
    flags = whole.select(cols.scenario).distinct().withColumn("has_whole", F.lit(True))
    per = per.join(small(flags), cols.scenario, "left").withColumn("has_whole", F.coalesce("has_whole", F.lit(False)))
    return per.withColumn(cols.value, F.when(F.col("has_whole"), F.col("whole")).otherwise(F.col("zero")))


def stage_values(flows: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """One row for each key: the null block's flow where its scenario has null blocks, else block 0's; slack of
    block 0. Counts for the block rules ride along in the same aggregate."""
    return _chosen(_by_key(flows, cols), flows.filter(F.col("block_id").isNull()), cols)


def _block_problem() -> Column:
    return (
        F.when(F.col("zero_rows") != 1, "block_0_not_once")
        .when(F.col("has_whole") & (F.col("whole_rows") != 1), "whole_row_not_once")
        .when(~F.col("has_whole") & F.coalesce("different", F.lit(False)), "flow_differs_between_blocks")
    )


def block_violations(values: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Q5, Q6 over ``stage_values``."""
    return values.withColumn("problem", _block_problem()).filter("problem is not null").select(*cols.key, "problem")


def lag_indices(lags: DataFrame) -> list[int]:
    """Q7: the distinct lag numbers (a handful); nulls and negatives are errors."""
    return _indices([r[0] for r in lags.select("lag_index").distinct().collect()])


def _indices(found: list[int | None]) -> list[int]:
    if not found or any(i is None or i < 0 for i in found):
        raise quality.QualityError(f"lag_index: {sorted(i if i is not None else -1 for i in found)}")
    return sorted(found)


def wide_lags(lags: DataFrame, indices: list[int], cols: Cols = ENSEMBLE, counted: bool = False) -> DataFrame:
    """One column for each lag, numbered from 1 if any index is 0; an absent lag is null. One shuffle.

    ``counted`` adds most_rows, the rows of the lag that has most of them.
    """
    shift = 1 if 0 in indices else 0
    at = lambda i: F.col("lag_index") == i
    per = [F.max(F.when(at(i), F.col(LAG_VALUE))).alias(f"lag_{i + shift}_m3s") for i in indices]
    if counted:
        per.append(F.array_max(F.array(*[F.sum(F.when(at(i), 1).otherwise(0)) for i in indices])).alias("most_rows"))
    return lags.groupBy(*cols.key).agg(*per)


def _matched(values: DataFrame, wide: DataFrame, cols: Cols) -> DataFrame:
    return _judged(values.join(wide, cols.key, "full"), cols)


def _judged(both: DataFrame, cols: Cols) -> DataFrame:
    """Both trees' aggregates by key, with whether each has the key, and its problem."""
    ours, theirs = F.col("zero_rows").isNotNull(), F.col("most_rows").isNotNull()
    nothing = F.greatest(*[F.col(k).isNull() for k in cols.key])
    problem = F.when(nothing, "null_key").when(~ours, "lag_without_flow").otherwise(F.coalesce(_block_problem(), F.when(F.col("most_rows") > 1, "repeated_lag")))
    return both.withColumns({"in_flows": ours, "in_lags": theirs, "problem": problem})


def tree_violations(both: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Q3-Q6, Q8 over the joined aggregates of both trees: (scenario, problem), one problem for each scenario that has any."""
    per = _judged(both, cols).groupBy(cols.scenario).agg(F.min("problem").alias("problem"), F.max("in_flows").alias("in_flows"), F.max("in_lags").alias("in_lags"))
    alone = F.when(~F.col("in_flows") | ~F.col("in_lags"), "scenario_in_one_tree_only")
    return per.select(cols.scenario, F.coalesce(alone, "problem").alias("problem")).filter("problem is not null")


def consolidate(flows: DataFrame, lags: DataFrame, checked: bool = True, cols: Cols = ENSEMBLE) -> DataFrame:
    """One row for each key with its flow, slack and lags; each tree is shuffled once, and the join works on that.

    Both sides have one row for each key, so the join keeps the number of rows (Q10). With ``checked`` the joined aggregates
    are stored once; the rules are jobs over them and one aggregate over the lags, and the result is read from them.
    """
    if not checked:
        values = stage_values(flows, cols)
        return values.select(*cols.key, cols.value, cols.slack).join(wide_lags(lags, lag_indices(lags), cols), cols.key, "left")
    for df, name in ((flows, "flows"), (lags, "lags")):
        if "path_scenario_id" in df.columns:
            quality.require(quality.wrong_path_ids(df, cols), f"scenario of path and row differ in {name}")
            quality.require(quality.several_files(df), f"scenario in several folders of {name}")
    nulls = lambda rows: [F.sum(F.when(F.col(k).isNull(), rows).otherwise(0)).alias(f"__{i}") for i, k in enumerate(cols.key)]
    named = lambda r: {k: r[f"__{i}"] for i, k in enumerate(cols.key) if r[f"__{i}"]}
    found = lags.groupBy("lag_index").agg(*nulls(F.lit(1))).collect()
    if gone := [named(r) for r in found if named(r)]:
        raise quality.QualityError(f"null key in lags: {gone[: quality.SHOWN]}")
    both = scratch(_by_key(flows, cols).join(wide_lags(lags, _indices([r["lag_index"] for r in found]), cols, counted=True), cols.key, "full"))
    if gone := named(both.agg(*nulls(F.coalesce("flow_rows", F.lit(0)))).first()):
        raise quality.QualityError(f"null key in flows: {gone}")
    both = _chosen(both, both.filter("whole_rows > 0"), cols)
    quality.require(tree_violations(both, cols), "flows and lags")
    return both.select(*cols.key, cols.value, cols.slack, *filters.lag_columns(both.columns))


def publish_consolidated(flows: DataFrame, lags: DataFrame, path: str, cols: Cols = ENSEMBLE) -> dict[str, int]:
    """``consolidate`` and ``publish`` in one: the job that writes the new folder also counts the rules' violations.

    The folder takes its place only if no key has a problem and it has as many rows as the flows have keys (Q10). An error
    names up to ``quality.SHOWN`` keys, one for each part of them by a hash. Returns the counts of that job.
    """
    quality.require(quality.only_in_one(flows, lags, cols.scenario), "scenarios of flows and lags")
    expected = flows.filter(F.col("block_id") == 0).count()
    both = _matched(stage_values(flows, cols), wide_lags(lags, lag_indices(lags), cols, counted=True), cols)
    key = F.struct("problem", *cols.key)
    part = F.pmod(F.xxhash64(*cols.key), F.lit(quality.SHOWN))
    wrong = F.col("problem").isNotNull()
    shown = [F.min(F.when(wrong & (part == i), key)).alias(f"shown_{i}") for i in range(quality.SHOWN)]
    counts = [F.count_if(wrong).alias("problems"), F.count_if("in_flows").alias("flow_keys"), F.count_if("in_lags").alias("lag_keys")]
    told: dict[str, int] = {}

    def write(folder: str) -> None:
        rules, rows = Observation("rules"), Observation("rows")
        # counted behind the range partitioning, which runs what stands before it twice
        ranged = both.repartitionByRange(cols.scenario).sortWithinPartitions(*cols.key).observe(rules, *counts, *shown)
        out = ranged.filter(~wrong).select(*cols.key, cols.value, cols.slack, *filters.lag_columns(both.columns))
        out.observe(rows, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(folder)
        got = rules.get
        if got["problems"]:
            examples = [got[f"shown_{i}"].asDict() for i in range(quality.SHOWN) if got[f"shown_{i}"] is not None]
            raise quality.QualityError(f"flows and lags: {got['problems']} keys, such as {', '.join(map(str, examples))}")
        told.update({c: got[c] for c in ("flow_keys", "lag_keys")}, rows=rows.get["rows"])
        if told["rows"] != expected:
            raise quality.QualityError(f"{told['rows']} rows after the join, {expected} before")

    replace(flows.sparkSession, path, write)
    return told
