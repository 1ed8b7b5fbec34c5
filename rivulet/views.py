"""An ensemble, its calendar, history, names and raw trees, derived from all of ``lineitem``, ``supplier`` and ``nation``.

Entity: supplier key modulo a tenth of the number of suppliers, so that entities grow with the tables. Scenario: part key
modulo 20. Stage: month of shipping. Value: total quantity times 355/113, less 10, with some nulls and infinities; slack:
number of lines modulo 3. History: an entity's monthly total over all lines, by the number of scenarios.

A second ensemble, ``many``, has groups that grow: twelve stages, the months of a year, and hundreds of scenarios, a fifth
of the number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.operators import ranges
from rivulet.sources.readers import with_order
from rivulet.sources.writers import scratch

LAGS = 6
SCENARIOS = 20
BLOCKS = (None, 0, 1, 2)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def entities(spark: SparkSession, sf_dir: str) -> int:
    return max(7, spark.read.parquet(f"{sf_dir}/supplier.parquet").count() // 10)


def scenarios(spark: SparkSession, sf_dir: str) -> int:
    """Scenarios of the second ensemble."""
    return max(300, spark.read.parquet(f"{sf_dir}/part.parquet").count() // 5)


def _stage(many: bool) -> Column:
    return F.month("l_shipdate") - 1 if many else F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1 - 23940


def ensemble(spark: SparkSession, sf_dir: str, many: bool = False) -> DataFrame:
    """The consolidated table; with ``many`` the second one."""
    entity = F.col("l_suppkey") % entities(spark, sf_dir)
    stage, number = _stage(many), scenarios(spark, sf_dir) if many else SCENARIOS
    cells = _lines(spark, sf_dir).groupBy(entity.cast("long").alias("hydro_id"), (F.col("l_partkey") % number).cast("long").alias("scenario_id"), stage.cast("long").alias("stage_id"))
    cells = cells.agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("c"))
    value = F.when((F.col("scenario_id") * 7 + F.col("stage_id")) % 23 == 0, None).when((F.col("scenario_id") * 5 + F.col("stage_id")) % 29 == 0, float("inf")).otherwise(F.col("q") * 355 / 113 - 10)
    slack = F.when(F.col("stage_id") % 11 == 0, None).otherwise((F.col("c") % 3).cast("double"))
    return cells.select("scenario_id", "stage_id", (F.col("stage_id") * 1000 + F.col("scenario_id")).alias("node_id"), "hydro_id", value.cast("double").alias("incremental_inflow_m3s"), slack.alias("inflow_nonnegativity_slack_m3s"))


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lags in long form, with an error of 1 in some, for the keys of the ensemble: a window brings each cell its earlier
    ones. There are no more cells than lines."""
    flows = ranges.spread(ensemble(spark, sf_dir), ["hydro_id", "scenario_id"], _lines(spark, sf_dir).count())
    w = Window.partitionBy("hydro_id", "scenario_id").orderBy("stage_id")
    # null where there is no such cell, a struct of null where its value is null
    past = [F.first(F.struct(F.lit(k).alias("lag_index"), F.col("incremental_inflow_m3s").alias("__v"))).over(w.rangeBetween(-k, -k)) for k in range(1, LAGS + 1)]
    rows = flows.withColumn("__past", F.array(*past)).select("scenario_id", "stage_id", "node_id", "hydro_id", F.explode(F.filter("__past", lambda p: p.isNotNull())).alias("p"))
    rows = rows.select("scenario_id", "stage_id", "node_id", "hydro_id", "p.*")
    off = (F.col("hydro_id") + F.col("scenario_id") + F.col("stage_id") + F.col("lag_index")) % 31 == 0
    return rows.select("scenario_id", "stage_id", "node_id", "hydro_id", "lag_index", (F.col("__v") + F.when(off, 1.0).otherwise(0.0)).alias("inflow_m3s"))


def with_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.operators.consolidate import wide_lags

    lags = wide_lags(shifted(spark, sf_dir), list(range(1, LAGS + 1)))
    return ensemble(spark, sf_dir).join(lags, ["scenario_id", "stage_id", "node_id", "hydro_id"], "left")


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by block; scenarios of even number also have a row without block."""
    blocks = F.explode(F.array(*[F.lit(b).cast("int") for b in BLOCKS])).alias("block_id")
    rows = ensemble(spark, sf_dir).select("*", blocks)
    return rows.filter(F.col("block_id").isNotNull() | (F.col("scenario_id") % 2 == 0))


def calendar(spark: SparkSession, sf_dir: str, many: bool = False) -> DataFrame:
    stages = _lines(spark, sf_dir).select(_stage(many).cast("long").alias("stage_id")).distinct()
    start = F.make_date((F.lit(1995) + F.floor(F.col("stage_id") / 12)).cast("int"), (F.col("stage_id") % 12 + 1).cast("int"), F.lit(1))
    return with_order(stages.select("stage_id", start.alias("start"), F.add_months(start, 1).alias("end")))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.trunc(F.col("l_shipdate").cast("date"), "MM")
    entity = (F.col("l_suppkey") % entities(spark, sf_dir)).cast("long").alias("hydro_id")
    rows = _lines(spark, sf_dir).groupBy(entity, start.alias("start")).agg((F.sum("l_quantity") * 355 / 113 / SCENARIOS - 10).alias("value"))
    return rows.select("hydro_id", "start", F.add_months("start", 1).alias("end"), "value", F.month("start").alias("month"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of entities of even number; the others have none."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return rows.select((F.col("n_nationkey") * 2).cast("long").alias("hydro_id"), F.trim("n_name").alias("name"))


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ensemble, history, calendar, names) for reports that read them many times: the first three are derived once."""
    derived = [scratch(f(spark, sf_dir)) for f in (ensemble, history, calendar)]
    return (*derived, names(spark, sf_dir))


# The same tables in SQL.
SQL = """
size AS (SELECT greatest(7, count(*) // 10) AS entities FROM supplier),
base AS (SELECT CAST(l_suppkey % (SELECT entities FROM size) AS BIGINT) AS hydro_id, CAST(l_partkey % 20 AS BIGINT) AS scenario_id,
    CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 - 23940 AS BIGINT) AS stage_id, sum(l_quantity) AS q, count(*) AS c
  FROM lineitem GROUP BY ALL),
ens AS (SELECT scenario_id, stage_id, stage_id * 1000 + scenario_id AS node_id, hydro_id,
    CASE WHEN (scenario_id * 7 + stage_id) % 23 = 0 THEN NULL WHEN (scenario_id * 5 + stage_id) % 29 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE q * 355 / 113 - 10 END AS v,
    CASE WHEN stage_id % 11 = 0 THEN NULL ELSE CAST(c % 3 AS DOUBLE) END AS slack FROM base),
fin AS (SELECT *, CASE WHEN isfinite(v) THEN v END AS x FROM ens),
lagl AS (SELECT e.scenario_id, e.stage_id, e.node_id, e.hydro_id, k AS lag,
    p.v + CASE WHEN (e.hydro_id + e.scenario_id + e.stage_id + k) % 31 = 0 THEN 1 ELSE 0 END AS y
  FROM ens e CROSS JOIN range(1, 7) r(k) JOIN ens p ON p.hydro_id = e.hydro_id AND p.scenario_id = e.scenario_id AND p.stage_id = e.stage_id - k),
cal AS (SELECT stage_id, make_date(1995 + stage_id // 12, stage_id % 12 + 1, 1) AS start_d, CAST(1995 + stage_id // 12 AS INTEGER) AS year, CAST(stage_id % 12 + 1 AS INTEGER) AS month,
    row_number() OVER (ORDER BY stage_id) - 1 AS ord FROM (SELECT DISTINCT stage_id FROM ens)),
hist AS (SELECT CAST(l_suppkey % (SELECT entities FROM size) AS BIGINT) AS hydro_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS start_d, sum(l_quantity) * 355 / 113 / 20 - 10 AS x,
    CAST(any_value(month(l_shipdate)) AS INTEGER) AS month, any_value(year(l_shipdate) * 12 + month(l_shipdate)) AS m
  FROM lineitem GROUP BY 1, 2),
names AS (SELECT CAST(n_nationkey * 2 AS BIGINT) AS hydro_id, trim(n_name) AS name FROM nation),
roll AS (SELECT hydro_id, scenario_id, stage_id, win, total FROM (
    SELECT f.hydro_id, f.scenario_id, f.stage_id, 6 AS win, count(*) OVER w AS n, count(x) OVER w AS nx, sum(x) OVER w AS total FROM fin f JOIN cal USING (stage_id)
      WINDOW w AS (PARTITION BY hydro_id, scenario_id ORDER BY ord RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)
    UNION ALL
    SELECT f.hydro_id, f.scenario_id, f.stage_id, 12, count(*) OVER w, count(x) OVER w, sum(x) OVER w FROM fin f JOIN cal USING (stage_id)
      WINDOW w AS (PARTITION BY hydro_id, scenario_id ORDER BY ord RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE n = win AND nx = win),
rollh AS (SELECT hydro_id, start_d, month, win, total FROM (
    SELECT *, 6 AS win, count(*) OVER w AS n, sum(x) OVER w AS total FROM hist WINDOW w AS (PARTITION BY hydro_id ORDER BY m RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)
    UNION ALL
    SELECT *, 12, count(*) OVER w, sum(x) OVER w FROM hist WINDOW w AS (PARTITION BY hydro_id ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE n = win)
"""

# With the second ensemble in the place of the first.
MANY_SQL = SQL.replace(
    "l_partkey % 20 AS", "l_partkey % (SELECT greatest(300, count(*) // 5) FROM part) AS"
).replace("CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 - 23940 AS BIGINT) AS stage_id, sum", "CAST(month(l_shipdate) - 1 AS BIGINT) AS stage_id, sum")
