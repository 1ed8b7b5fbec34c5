"""The reports: statistics, slices, correlations, distances, profiles, densities, pages and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.columns import ENSEMBLE, Cols
from rivulet.functions.labels import month_label, percent_label, period_label
from rivulet.functions.numeric import finite
from rivulet.operators import browse as pages
from rivulet.operators import correlation, filters, ks, quality, ranges, slices, summaries, windows
from rivulet.operators.density import density_summary
from rivulet.operators.joins import named, small


def checked(df: DataFrame, calendar: DataFrame, cols: Cols = ENSEMBLE, gaps: bool = False) -> DataFrame:
    """Raises unless keys are unique, nodes are there and stages are in the calendar: one aggregate over the data.

    The calendar itself must be whole months without gaps, unless ``gaps`` are allowed.
    """
    quality.require(quality.bad_groups(df, cols, calendar), "repeated or incomplete (entity, stage), or stage not in the calendar")
    wrong = quality.bad_calendar(calendar, cols.stage)
    quality.require(wrong.filter("problem <> 'gap_or_overlap'") if gaps else wrong, "calendar")
    return df


def checked_history(history: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Raises unless history has whole months, each once for an entity."""
    quality.require(quality.bad_history(history, cols, "start", "end"), "history")
    return history


def _large(df: DataFrame, history: DataFrame, cols: Cols) -> tuple[int | None, int]:
    """(``ranges.LARGE`` if an (entity, stage) or an (entity, month) has more rows, else None; all rows): counted once for a report.

    Rolling sums have no more rows than the flows they end at.
    """
    tables = ((df, cols.group), (history, [cols.entity, "month"]))
    found = [ranges.group_rows(t, by).agg(F.max("rows"), F.sum("rows")).first() for t, by in tables]
    most, rows = (f(r[i] or 0 for r in found) for i, f in enumerate((max, sum)))
    return ranges.LARGE if most > ranges.LARGE else None, rows


def _stats() -> list[str]:
    return ["n", "mean", "sd", "skewness", "kurtosis", "minimum", "maximum"]


def statistical_report(df: DataFrame, history: DataFrame, calendar: DataFrame, names: DataFrame, sizes: tuple[int, ...] = windows.SIZES, cols: Cols = ENSEMBLE) -> DataFrame:
    """Moments of flows (window 0) and rolling sums of both sources: stages of scenarios, all twelve months of history."""
    df, history = checked(df, calendar, cols), checked_history(history, cols)
    cal = small(calendar.select(cols.stage, "order", "month", "start"))
    rolling = windows.rolling_sums(df, calendar, sizes, cols)
    ours = summaries.moment_summary(df.withColumn("window", F.lit(0)), [*cols.group, "window"], cols.value)
    ours = ours.unionByName(summaries.moment_summary(rolling, [*cols.group, "window"], "total"))
    ours = ours.join(cal, cols.stage).select(cols.entity, F.lit("scenarios").alias("source"), "window", cols.stage, "month", F.col("order").alias("position"), *_stats())
    past = history.select(cols.entity, "month", F.lit(0).alias("window"), F.col("value").alias("x"))
    past = past.unionByName(windows.rolling_history(history, sizes, cols).select(cols.entity, "month", "window", F.col("total").alias("x")))
    per = summaries.moment_summary(past, [cols.entity, "window", "month"], "x")
    grid = history.select(cols.entity).distinct().withColumn("window", F.explode(F.array(*[F.lit(k) for k in (0, *sizes)]))).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    per = grid.join(per, [cols.entity, "window", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    theirs = per.select(cols.entity, F.lit("history").alias("source"), "window", F.lit(None).cast("long").alias(cols.stage), "month", F.col("month").alias("position"), *_stats())
    return named(theirs.unionByName(ours), names, cols.entity)


def report_order(report: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """T4: entity, history first, window, then month or calendar order."""
    return report.orderBy(cols.entity, F.when(F.col("source") == "history", 0).otherwise(1), "window", "position")


def slice_report(df: DataFrame, history: DataFrame, calendar: DataFrame, names: DataFrame, sizes: tuple[int, ...] = windows.SIZES, percents: tuple[int, ...] = slices.PERCENTS, cols: Cols = ENSEMBLE) -> DataFrame:
    """Lowest-percent slices of flows and rolling sums, both sources in one ranking; history has all months and percents."""
    df, history = checked(df, calendar, cols), checked_history(history, cols)
    large, rows = _large(df, history, cols)
    ours = df.select(F.lit("scenarios").alias("source"), F.lit(0).alias("window"), cols.entity, F.col(cols.stage).alias("period"), F.col(cols.scenario).alias("tie"), F.col(cols.value).alias("x"))
    ours = ours.unionByName(windows.rolling_sums(ranges.spread(df, [cols.entity, cols.scenario], rows), calendar, sizes, cols).select(F.lit("scenarios").alias("source"), "window", cols.entity, F.col(cols.stage).alias("period"), F.col(cols.scenario).alias("tie"), F.col("total").alias("x")))
    tie = F.datediff("start", F.lit("1900-01-01")).cast("long").alias("tie")
    past = history.select(F.lit("history").alias("source"), F.lit(0).alias("window"), cols.entity, F.col("month").cast("long").alias("period"), tie, F.col("value").alias("x"))
    past = past.unionByName(windows.rolling_history(history, sizes, cols).select(F.lit("history").alias("source"), "window", cols.entity, F.col("month").cast("long").alias("period"), tie, F.col("total").alias("x")))
    # a row without value for every month of history, so that months without a finite one are reported too
    months = F.explode(F.sequence(F.lit(1), F.lit(12)).cast("array<long>"))
    grid = history.select(cols.entity).distinct().withColumn("window", F.explode(F.array(*[F.lit(k) for k in (0, *sizes)]))).withColumn("period", months)
    past = past.unionByName(grid.withColumns({"source": F.lit("history"), "tie": F.lit(None).cast("long"), "x": F.lit(None).cast("double")}))
    out = slices.slices(ours.unionByName(past), ["source", "window", cols.entity, "period"], "x", "tie", percents, empty=True, large=large, rows=rows * (1 + len(sizes)))
    return named(out, names, cols.entity).withColumnRenamed("label", "entity_label").withColumn("label", percent_label(F.col("percent")))


def lag_report(df: DataFrame, calendar: DataFrame, names: DataFrame, cols: Cols = ENSEMBLE) -> tuple[DataFrame, DataFrame]:
    """(a column of correlations for each lag, the long form with every reason); wrong keys blank a correlation."""
    quality.require(quality.unknown_stages(df, calendar, cols), "stage not in the calendar")
    detail = named(correlation.lag_correlation(df, calendar, cols), names, cols.entity)
    lags = [0, *(int(c.split("_")[1]) for c in filters.lag_columns(df.columns))]
    return named(correlation.lag_table(detail, lags, cols), names, cols.entity), detail


def spatial_report(df: DataFrame, calendar: DataFrame, names: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Pairs of each stage with the pairs expected (A18) and the labels of both entities."""
    df = checked(df, calendar, cols, gaps=True)
    out = correlation.spatial_correlation(df, cols=cols).join(small(summaries.pairs_expected(df, cols)), cols.stage)
    for side in ("a", "b"):
        out = named(out, names.withColumnRenamed(cols.entity, side), side).withColumnRenamed("label", f"label_{side}")
    return out.join(small(calendar.select(cols.stage, period_label(F.col("start")).alias("period"))), cols.stage)


def annual_report(df: DataFrame, calendar: DataFrame, names: DataFrame, cols: Cols = ENSEMBLE) -> tuple[DataFrame, DataFrame]:
    """(a column of correlations for each lag, the long form with every reason)."""
    quality.require(quality.bad_years(df, calendar, cols), "repeated or incomplete (entity, scenario, year), or stage not in the calendar")
    detail = named(correlation.annual_correlation(df, calendar, cols=cols), names, cols.entity)
    return named(correlation.annual_table(detail, cols=cols), names, cols.entity), detail


def ks_report(df: DataFrame, history: DataFrame, calendar: DataFrame, names: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    df, history = checked(df.drop(cols.node), calendar, cols, gaps=True), checked_history(history, cols)
    return named(ks.ks_distance(df, history, calendar, cols), names, cols.entity)


def stage_profile(df: DataFrame, history: DataFrame, calendar: DataFrame, names: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """A5, A6, A8 of flow, slack and history, J6, J7, A24, Q18, Q19 and Q20 side by side for each (entity, stage)."""
    df, history = checked(df, calendar, cols, gaps=True), checked_history(history, cols)
    cal = small(calendar.select(cols.stage, "order", "month"))
    large, rows = _large(df, history, cols)
    # rows are shuffled once for flow, slack and counts, which a task holds side by side
    df = df if large else ranges.spread(df, cols.group, 3 * rows)
    out = summaries.stage_series(df, cols.group, cols.value)
    box = slices.box_plot(df, cols.group, cols.value, cols.scenario, large=large).select(*cols.group, "minimum", "q1", "median", "q3", "maximum", "whisker_low", "whisker_high", "outliers", "skewness", "kurtosis")
    more = df.groupBy(*cols.group).agg(F.avg(finite(cols.slack)).alias("mean_slack"), F.count(F.lit(1)).alias("rows"), F.count_distinct(cols.scenario).alias("scenarios"))
    past = [*[F.col(c).alias(f"history_{c}") for c in ("n", "mean", "sd", "skewness", "kurtosis")]]
    past = summaries.moment_summary(history, [cols.entity, "month"], "value").select(cols.entity, "month", *past)
    boxes = lambda rows, by, value, tie, name: slices.box_plot(rows, by, value, tie, large=large).select(*by, *[F.col(c).alias(f"{name}_{c}") for c in ("q1", "median", "q3", "whisker_low", "whisker_high", "outliers")])
    past = past.join(boxes(history, [cols.entity, "month"], "value", "start", "history"), [cols.entity, "month"], "left")
    more = more.join(boxes(df, cols.group, cols.slack, cols.scenario, "slack"), cols.group, "left")
    out = out.join(box, cols.group, "left").join(more, cols.group, "left").join(cal, cols.stage).withColumn("missing", F.col("rows") - F.col("n"))
    out = out.join(past, [cols.entity, "month"], "left").withColumn("history_n", F.coalesce("history_n", F.lit(0))).withColumn("month_name", month_label(F.col("month")))
    held = history.select(cols.entity, "month").distinct().withColumn("in_history", F.lit(True))
    out = out.join(held, [cols.entity, "month"], "left").withColumn("in_history", F.coalesce("in_history", F.lit(False)))
    return named(out, names, cols.entity)


def density_report(df: DataFrame, history: DataFrame, calendar: DataFrame, names: DataFrame, percent: int | None = None, cols: Cols = ENSEMBLE) -> DataFrame:
    """A22 of the stages of scenarios and the months of history, or (A23) of the lowest ``percent`` of each."""
    df, history = checked(df, calendar, cols, gaps=True), checked_history(history, cols)
    ours = df.select(F.lit("scenarios").alias("source"), cols.entity, F.col(cols.stage).alias("period"), F.col(cols.scenario).alias("tie"), F.col(cols.value).alias("v"))
    tie = F.datediff("start", F.lit("1900-01-01")).cast("long")
    both = ours.unionByName(history.select(F.lit("history").alias("source"), cols.entity, F.col("month").cast("long").alias("period"), tie.alias("tie"), F.col("value").alias("v")))
    by = ["source", cols.entity, "period"]
    large, rows = _large(df, history, cols)
    both = both if large else ranges.spread(both, by, rows)
    out = density_summary(both if percent is None else slices.lowest(both, by, "v", "tie", percent, large), by, "v")
    return named(out, names, cols.entity)


def browse(df: DataFrame, order: str, descending: bool = False, number: int = 1, size: int = 100, negative: bool = False, cols: Cols = ENSEMBLE, **equal) -> tuple[DataFrame, int, int]:
    """(page, rows in all, pages) of the filtered records."""
    rows = filters.where(df, **equal)
    rows = filters.negative_flows(rows, cols) if negative else rows
    total = rows.count()
    return pages.page(filters.ordered_columns(rows, cols), order, descending, number, size, cols), total, pages.page_count(total, size)


def evidence(df: DataFrame, case: Column, cols: Cols = ENSEMBLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of the case, suspicious rows, counts of both)."""
    rows = filters.ordered_columns(df, cols)
    return rows.filter(case), rows.filter(filters.suspicious(cols)), summaries.evidence_counts(df, case, cols)
