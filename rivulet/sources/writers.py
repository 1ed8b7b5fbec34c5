"""Writers (S7-S9): a dataset appears under its path only when it is complete and checked."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.columns import ENSEMBLE, Cols
from rivulet.operators.browse import page_order


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Puts what ``write`` leaves in a new folder in the place of ``path``, which stays as it is if anything fails."""
    fresh, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    move = lambda a, b: fs.rename(jvm.org.apache.hadoop.fs.Path(a), jvm.org.apache.hadoop.fs.Path(b))
    try:
        write(fresh)
    except BaseException:
        fs.delete(jvm.org.apache.hadoop.fs.Path(fresh), True)
        raise
    if fs.exists(target) and not move(path, old):
        raise OSError(f"cannot move {path}")
    if not move(fresh, path):
        move(old, path)
        raise OSError(f"cannot publish {path}")
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, partitions: int | None = None, by: str = "scenario", cols: Cols = ENSEMBLE) -> None:
    """Zstd Parquet in key order, range-partitioned by scenario or entity; the old output stays until ``check`` passes."""
    lead = {"scenario": [cols.scenario], "entity": [cols.entity, cols.scenario]}[by]
    order = [*lead, *[k for k in cols.key if k not in lead]]
    ranged = df.repartitionByRange(partitions, *lead) if partitions else df.repartitionByRange(*lead)

    def write(folder: str) -> None:
        ranged.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(folder)
        if check:
            check(df.sparkSession.read.parquet(folder))

    replace(df.sparkSession, path, write)


def write_report(report: DataFrame, diagnostics: DataFrame | None, path: str, form: str = "parquet") -> None:
    """A report and its diagnostics as two datasets with full-precision numbers; both appear, or neither."""

    def write(folder: str) -> None:
        for name, df in (("report", report), ("diagnostics", diagnostics)):
            if df is not None:
                out = df.write.format(form)
                (out.option("header", True) if form == "csv" else out).save(f"{folder}/{name}")

    replace(report.sparkSession, path, write)


def run_summary(df: DataFrame, cols: Cols = ENSEMBLE) -> DataFrame:
    """Rows, scenarios, stages and entities of a dataset."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c).alias(n) for c, n in ((cols.scenario, "scenarios"), (cols.stage, "stages"), (cols.entity, "entities"))])


def new_folder(spark: SparkSession) -> str:
    """A path under ``spark.checkpoint.dir``; a local one only where that is unset on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rivulet-")
    return f"{base.rstrip('/')}/rivulet-{uuid.uuid4().hex}"


def scratch(df: DataFrame) -> DataFrame:
    """``df`` written once to a folder of its own: what reads it several times computes it once."""
    folder = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def publish_pages(df: DataFrame, path: str, column: str, descending: bool = False, partitions: int | None = None, cols: Cols = ENSEMBLE) -> None:
    """T1 for any depth: the rows in page order as ranges, and a directory of where each range starts.

    ``browse.stored_page`` then opens only the ranges that a page lies in.
    """
    order = page_order(column, descending, cols)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)

    def write(folder: str) -> None:
        rows = ranged.withColumn("page_part", F.spark_partition_id()).sortWithinPartitions("page_part", *order)
        rows.write.partitionBy("page_part").option("compression", "zstd").parquet(f"{folder}/rows")
        df.limit(0).write.parquet(f"{folder}/schema")
        stored = df.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
        counts = stored.groupBy("page_part").agg(F.count(F.lit(1)).alias("rows"))
        # one row for each range
        first = F.sum("rows").over(Window.orderBy("page_part")) - F.col("rows")
        counts.select("page_part", first.alias("first"), "rows").write.parquet(f"{folder}/directory")

    replace(df.sparkSession, path, write)


def layout_keys(by: str, cols: Cols = ENSEMBLE) -> list[str]:
    """The groups that a bucketed dataset keeps together: the samples of a stage, or the series of a scenario."""
    return {"stage": cols.group, "scenario": [cols.entity, cols.scenario]}[by]


def publish_buckets(df: DataFrame, path: str, by: str = "stage", buckets: int = 200, large: int | None = None, cols: Cols = ENSEMBLE) -> None:
    """S7 for repeated reports: bucketed by (entity, stage) or (entity, scenario) and sorted, one file for each bucket.

    ``readers.over_groups`` then runs jobs on those groups without a shuffle of rows. Groups with more than ``large`` rows
    (``ranges.LARGE`` if None), which would make a bucket of one task, are stored apart, in ranges.
    """
    from rivulet.operators import ranges

    keys = layout_keys(by, cols)
    order = [*keys, *[k for k in cols.key if k not in keys]]
    hot = ranges.large_groups(ranges.group_rows(df, keys), keys, ranges.LARGE if large is None else large)
    rest, rows = (df, None) if hot is None else ranges.parted(df, keys, hot)
    spark = df.sparkSession

    def write(folder: str) -> None:
        name = f"rivulet_{uuid.uuid4().hex}"
        out = rest.repartition(buckets, *keys).write.option("compression", "zstd").option("path", f"{folder}/rows")
        out.bucketBy(buckets, *keys).sortBy(*order).saveAsTable(name)
        # an external table: its files stay, and readers name them anew where they lie in the end
        spark.sql(f"DROP TABLE {name}")
        if rows is not None:
            rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(f"{folder}/large")
        layout = spark.createDataFrame([(keys, order, buckets, rows is not None)], "keys array<string>, sorted array<string>, buckets int, split boolean")
        layout.coalesce(1).write.parquet(f"{folder}/layout")
        df.limit(0).write.parquet(f"{folder}/schema")

    replace(spark, path, write)
