"""Readers of scenario trees, consolidated tables, catalogs, calendars and histories."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.columns import ENSEMBLE, Cols
from rivulet.functions.numeric import to_date, to_double
from rivulet.operators.quality import QualityError, bad_folders, only_in_one, require, require_columns

PATH_ID = r"/scenario_id=(\d+)/data\.parquet$"
SCENARIO_FILE = r"/scenario_id=[^/]*/data\.parquet$"
FLOWS = "scenario_id long, stage_id long, node_id long, hydro_id long, block_id int, incremental_inflow_m3s double, inflow_nonnegativity_slack_m3s double"
LAGS = "scenario_id long, stage_id long, node_id long, hydro_id long, lag_index int, inflow_m3s double"


def _files(spark: SparkSession, path: str, reader: DataFrameReader, form: str) -> DataFrame:
    """What ``reader`` finds in ``<path>/scenario_id=*/data.parquet``: folders below ``path`` are listed in parallel."""
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "data.parquet").format(form).load(f"{path.rstrip('/')}/scenario_id=*")


def read_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tree of ``scenario_id=<n>/data.parquet``; the path's number (0001 is 1) and the file beside the stored columns.

    Other files and folders are not read; ``checked_tree`` refuses those that should have been scenarios.
    """
    rows = _files(spark, path, spark.read.schema(schema), "parquet")
    file = F.col("_metadata.file_path")
    rows = rows.filter(file.rlike(SCENARIO_FILE))  # a predicate on files: others are not opened
    return rows.select("*", F.regexp_extract(file, PATH_ID, 1).try_cast("long").alias("path_scenario_id"), F.regexp_extract(file, r"(.*)/[^/]*", 1).alias("file_path"))


def _entries(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, whether it is a folder) of what ``path`` holds under ``scenario_id=*``: one listing, read as one text."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder) or not fs.getFileStatus(folder).isDirectory():
        raise QualityError(f"no such folder: {path}")
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "scenario_id=*"))
    told = jvm.org.apache.commons.lang3.ArrayUtils.toString(found)
    return [(p.rpartition("/")[2], kind == "true") for p, kind in re.findall(r"path=([^;]*); isDirectory=(true|false);", told)]


def tree_manifest(spark: SparkSession, path: str, schema: str, cols: Cols = ENSEMBLE) -> DataFrame:
    """One row for each entry ``scenario_id=*`` of a tree: (folder, is_folder, scenario, bytes, rows, nulls, least, most).

    ``bytes`` is null without a data.parquet; rows, nulls and the range of stored scenarios come from one scan of that
    column alone.
    """
    entries = _entries(spark, path)
    kinds = "folder string, is_folder boolean"
    listed = spark.createDataFrame(entries, kinds).withColumn("scenario", F.regexp_extract("folder", r"^scenario_id=(\d+)$", 1).try_cast("long"))
    if not entries:
        return listed.selectExpr("*", "0L AS bytes", "0L AS rows", "0L AS nulls", "0L AS least", "0L AS most")
    folder = lambda c: F.regexp_extract(c, r"/(scenario_id=[^/]*)/data\.parquet$", 1).alias("folder")
    direct = rf"/{re.escape(path.rstrip('/').rpartition('/')[2])}/scenario_id=[^/]*/data\.parquet$"
    files = _files(spark, path, spark.read, "binaryFile").filter(F.col("path").rlike(direct)).select(folder("path"), F.col("length").alias("bytes"))
    rows = _files(spark, path, spark.read.schema(schema), "parquet").select(F.col("_metadata.file_path").alias("path"), cols.scenario)
    held = rows.filter(F.col("path").rlike(direct)).groupBy(folder("path")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(cols.scenario).isNull()).alias("nulls"), F.min(cols.scenario).alias("least"), F.max(cols.scenario).alias("most"))
    return listed.join(files, "folder", "left").join(held, "folder", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("rows", "nulls")})


def checked_tree(spark: SparkSession, path: str, schema: str, cols: Cols = ENSEMBLE) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest) of a tree whose folders are all in order (Q1, Q2, Q4); ``QualityError`` otherwise."""
    manifest = tree_manifest(spark, path, schema, cols)
    require(bad_folders(manifest), f"scenario folders of {path}")
    if manifest.isEmpty():
        raise QualityError(f"no scenario_id=* in {path}")
    return read_tree(spark, path, schema).drop("path_scenario_id", "file_path"), manifest


def checked_trees(spark: SparkSession, flows: str, lags: str, cols: Cols = ENSEMBLE) -> tuple[DataFrame, DataFrame]:
    """Rows of both trees, which must have the same scenarios; what is left to check is what rows say of each other."""
    (ours, mine), (theirs, other) = checked_tree(spark, flows, FLOWS, cols), checked_tree(spark, lags, LAGS, cols)
    require(only_in_one(mine, other, "scenario"), "scenarios of flows and lags")
    return ours, theirs


def read_consolidated(spark: SparkSession, path: str, columns: list[str] | None = None, cols: Cols = ENSEMBLE) -> DataFrame:
    """A consolidated table with only the columns asked for."""
    df = spark.read.parquet(path)
    require_columns(df, columns or [*cols.key, cols.value])
    return df.select(*columns) if columns else df


def read_catalog(spark: SparkSession, path: str, cols: Cols = ENSEMBLE) -> DataFrame:
    """``{"hydros": [{"id", "name"}]}`` as (entity, name), names trimmed."""
    rows = spark.read.schema("hydros array<struct<id: long, name: string>>").json(path, multiLine=True)
    return rows.select(F.inline("hydros")).select(F.col("id").alias(cols.entity), F.trim("name").alias("name"))


def read_calendar(spark: SparkSession, path: str, cols: Cols = ENSEMBLE) -> DataFrame:
    """``{"stages": [{"id", "start_date", "end_date"}]}`` as a calendar."""
    rows = spark.read.schema("stages array<struct<id: long, start_date: string, end_date: string>>").json(path, multiLine=True)
    rows = rows.select(F.inline("stages"))
    return with_order(rows.select(F.col("id").alias(cols.stage), to_date("start_date").alias("start"), to_date("end_date").alias("end")))


def with_order(stages: DataFrame) -> DataFrame:
    """(stage, start, end) with month, year and chronological order (some hundreds of rows: one window)."""
    order = F.row_number().over(Window.orderBy("start")) - 1
    return stages.select("*", F.month("start").alias("month"), F.year("start").alias("year"), order.alias("order"))


def read_history(spark: SparkSession, path: str, cols: Cols = ENSEMBLE) -> DataFrame:
    """Monthly history with tolerant casts."""
    return tidy_history(spark.read.parquet(path), cols)


def tidy_history(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    return df.select(cols.entity, to_date("start_date").alias("start"), to_date("end_date").alias("end"), to_double("value_m3s").alias("value"), F.month(to_date("start_date")).alias("month"))


def read_buckets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows in their buckets, rows of groups stored apart or None) of what ``writers.publish_buckets`` wrote.

    Spark knows buckets by a table alone, so an external one, named after the path, is put into the current database.
    """
    layout, schema = spark.read.parquet(f"{path}/layout").first(), spark.read.parquet(f"{path}/schema").schema
    name = f"rivulet_buckets_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    quoted = lambda names: ", ".join(f"`{c}`" for c in names)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    escaped = path.rstrip("/").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    clustered = f"CLUSTERED BY ({quoted(layout['keys'])}) SORTED BY ({quoted(layout['sorted'])}) INTO {layout['buckets']} BUCKETS"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {clustered} LOCATION '{escaped}/rows'")
    return spark.table(name), spark.read.schema(schema).parquet(f"{path}/large") if layout["split"] else None


def over_groups(spark: SparkSession, path: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``job``, which works on each stored group alone, over a bucketed dataset: no shuffle where groups lie in
    buckets, and ``job``'s own way for the groups stored apart."""
    rows, large = read_buckets(spark, path)
    return job(rows) if large is None else job(rows).unionByName(job(large))
