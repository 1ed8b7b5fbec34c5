"""Labels and month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in order.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def entity_label(name: Column, entity: Column) -> Column:
    """``name - id``; the id alone where the name is missing or blank."""
    return F.when(F.length(F.trim(name)) > 0, F.concat_ws(" - ", F.trim(name), entity.cast("string"))).otherwise(F.concat(F.lit("entity "), entity.cast("string")))


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month.cast("int"))


def period_label(start: Column) -> Column:
    return F.date_format(start, "MM/yyyy")


def percent_label(p: Column) -> Column:
    return F.concat(F.lit("p"), p.cast("string"), F.lit("%"))


def month_index(date: Column) -> Column:
    """Months since year 0; consecutive months differ by one."""
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def month_before(start: Column, k: Column | int) -> Column:
    return F.add_months(start, -k)


def next_month(date: Column) -> Column:
    return F.add_months(F.trunc(date, "MM"), 1)
