"""Finite masks, tolerant casts, and moments (F1, F2, A3, A5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column | str) -> Column:
    """``v`` if it is a finite number, else null."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def to_double(v: Column | str) -> Column:
    """null where the cast fails."""
    return (F.col(v) if isinstance(v, str) else v).try_cast("double")


def to_date(v: Column | str) -> Column:
    """null where the cast fails."""
    return (F.col(v) if isinstance(v, str) else v).try_cast("date")


#: Values whose range is at most this share of their size are constant: sums of equal terms differ in their last bits.
LEAST_RANGE = 1e-12


def moments(v: Column, prefix: str = "") -> list[Column]:
    """Aggregates of the finite values: n, mean, population sd, skewness, excess kurtosis, min, max; a group that is
    constant, or all but rounding (``LEAST_RANGE``), has no skewness and no kurtosis."""
    sd = F.when(F.min(v) == F.max(v), F.lit(0.0)).otherwise(F.stddev_pop(v))
    shaped = (F.count(v) >= 2) & (F.max(v) - F.min(v) > LEAST_RANGE * F.greatest(F.abs(F.min(v)), F.abs(F.max(v))))
    named = {"n": F.count(v), "mean": F.avg(v), "sd": sd, "skewness": F.when(shaped, F.skewness(v)), "kurtosis": F.when(shaped, F.kurtosis(v)), "minimum": F.min(v), "maximum": F.max(v)}
    return [c.alias(prefix + k) for k, c in named.items()]


def compensated(values: Column) -> Column:
    """Sum of an array of finite values with the rounding of each step added at the end (Neumaier)."""

    def add(held: Column, v: Column) -> Column:
        s = held["s"] + v
        lost = F.when(F.abs(held["s"]) >= F.abs(v), (held["s"] - s) + v).otherwise((v - s) + held["s"])
        return F.struct(s.alias("s"), (held["c"] + lost).alias("c"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), add, lambda held: held["s"] + held["c"])


def pair_moments(x: Column, y: Column) -> list[Column]:
    """Aggregates over the pairs of which both values are finite."""
    ok = x.isNotNull() & y.isNotNull()
    x, y = F.when(ok, x), F.when(ok, y)
    named = {"n": F.count(x), "mean_x": F.avg(x), "mean_y": F.avg(y), "sd_x": F.stddev_pop(x), "sd_y": F.stddev_pop(y), "cov": F.covar_pop(x, y), "min_x": F.min(x), "max_x": F.max(x), "min_y": F.min(y), "max_y": F.max(y)}
    return [c.alias(k) for k, c in named.items()]


def pearson(bad_keys: Column | None = None, bounds: bool = True) -> tuple[Column, Column]:
    """(rho, reason) over the columns of ``pair_moments``; the reason is ``computed`` if rho has a value.

    Without ``bounds`` there are no least and greatest values, and the deviation of equal values is exactly 0.
    """
    n, mx, my, sx, sy = (F.col(c) for c in ("n", "mean_x", "mean_y", "sd_x", "sd_y"))
    flat = lambda s, lo, hi: (s == 0) | (F.col(lo) == F.col(hi)) if bounds else s == 0
    near = lambda s, m: s * F.sqrt(n) < F.lit(1e-13) * F.abs(m)
    raw = F.try_divide(F.col("cov"), sx * sy)
    reason = F.when(n < 2, "lt2_pairs")
    if bad_keys is not None:
        reason = reason.when(bad_keys, "bad_keys")
    reason = reason.when(finite(sx).isNull() | finite(sy).isNull(), "sd_unavailable")
    reason = reason.when(flat(sx, "min_x", "max_x") | flat(sy, "min_y", "max_y"), "constant")
    reason = reason.when(near(sx, mx) | near(sy, my), "near_constant")
    reason = reason.when(finite(raw).isNull() | (F.abs(raw) > 1 + 1e-10), "invalid_rho").otherwise("computed")
    return F.when(reason == "computed", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))), reason
