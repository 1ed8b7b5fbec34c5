"""Joins with small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension that is broadcast at most.
MOST_ROWS = 100_000


def small(dimension: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``dimension`` with a broadcast hint if it has at most ``most`` rows, unchanged beyond that.

    Up to ``most`` rows and one come to the driver for the check, and those are what is broadcast: an aggregate, such as the
    stages of a study with their counts, is computed once, not once to count it and once to send it.
    """
    held = dimension.limit(most + 1).toArrow()
    return F.broadcast(dimension.sparkSession.createDataFrame(held, dimension.schema)) if held.num_rows <= most else dimension


def named(df: DataFrame, names: DataFrame, entity: str = "hydro_id") -> DataFrame:
    """Adds ``label``; names has (entity, name)."""
    from rivulet.functions.labels import entity_label

    joined = df.join(small(names.select(entity, F.col("name").alias("__name"))), entity, "left")
    return joined.withColumn("label", entity_label(F.col("__name"), F.col(entity))).drop("__name")
