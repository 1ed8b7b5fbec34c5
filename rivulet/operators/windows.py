"""Rolling sums and the lag audit (W1-W5): one shuffle and one sort for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.columns import ENSEMBLE, Cols
from rivulet.functions.labels import month_index
from rivulet.functions.numeric import finite
from rivulet.operators.filters import lag_columns
from rivulet.operators.joins import small

SIZES = (6, 12)


def _sums(df: DataFrame, by: list[str], order: str, value: Column, sizes: tuple[int, ...]) -> DataFrame:
    rows = df.withColumn("__v", value)
    out = []
    for k in sizes:
        w = Window.partitionBy(*by).orderBy(order).rangeBetween(-(k - 1), 0)
        whole = (F.count("__v").over(w) == k) & (F.count(F.lit(1)).over(w) == k)
        out.append(F.struct(F.lit(k).alias("window"), F.when(whole, F.sum("__v").over(w)).alias("total")))
    rows = rows.withColumn("__a", F.array(*out)).select(*df.columns, F.explode("__a").alias("__s"))
    return rows.select(*df.columns, "__s.window", "__s.total").filter("total is not null")


def rolling_sums(df: DataFrame, calendar: DataFrame, sizes: tuple[int, ...] = SIZES, cols: Cols = ENSEMBLE) -> DataFrame:
    """(entity, scenario, stage, window, total) of complete, contiguous, finite windows, at their last stage."""
    rows = df.select(cols.entity, cols.scenario, cols.stage, cols.value).join(small(calendar.select(cols.stage, "order")), cols.stage)
    out = _sums(rows, [cols.entity, cols.scenario], "order", finite(cols.value), sizes)
    return out.select(cols.entity, cols.scenario, cols.stage, "window", "total")


def rolling_history(history: DataFrame, sizes: tuple[int, ...] = SIZES, cols: Cols = ENSEMBLE) -> DataFrame:
    """The same over consecutive months of history, at the last month."""
    rows = history.select(cols.entity, "start", "month", "value").withColumn("__m", month_index(F.col("start")))
    return _sums(rows, [cols.entity], "__m", finite("value"), sizes).select(cols.entity, "start", "month", "window", "total")


def lag_number(name: str) -> int:
    return int(name.split("_")[1])


def lag_checks(lags: list[str], tolerance: float = 1e-8, cols: Cols = ENSEMBLE) -> list[Column]:
    """1 where an exported lag differs from the flow that many stages before, else 0; rows have the stage's ``order``."""
    w = Window.partitionBy(cols.entity, cols.scenario).orderBy("order")
    checks = []
    for name in lags:
        k = lag_number(name)
        past, gap = finite(F.lag(cols.value, k).over(w)), F.col("order") - F.lag("order", k).over(w)
        given = finite(name)
        far = F.abs(given - past) > tolerance * F.greatest(F.lit(1.0), F.abs(past))
        wrong = gap.isNull() | (gap != k) | F.coalesce(far, F.lit(False))
        checks.append(F.when((F.col("order") >= k) & wrong, 1).otherwise(0))
    return checks


def lag_audit(df: DataFrame, calendar: DataFrame, tolerance: float = 1e-8, cols: Cols = ENSEMBLE) -> DataFrame:
    """(entity, stage, lag, mismatches): exported lags that differ from the flow that many stages before."""
    lags = lag_columns(df.columns)
    rows = df.select(cols.entity, cols.scenario, cols.stage, cols.value, *lags).join(small(calendar.select(cols.stage, "order")), cols.stage)
    checks = [F.struct(F.lit(lag_number(name)).alias("lag"), c.alias("wrong")) for name, c in zip(lags, lag_checks(lags, tolerance, cols), strict=True)]
    each = rows.withColumn("__c", F.array(*checks)).select(*cols.group, F.explode("__c").alias("c")).select(*cols.group, "c.lag", "c.wrong")
    return each.groupBy(*cols.group, "lag").agg(F.sum("wrong").alias("mismatches"))


def lag_origin(order: Column, lag: Column) -> Column:
    """W5."""
    return F.when(lag == 0, "current").when(order >= lag, "simulated").otherwise("before_study")
