"""Lowest-percent slices and box-plot statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.numeric import LEAST_RANGE, finite
from rivulet.operators import ranges

PERCENTS = tuple(range(5, 100, 5))
#: Quartiles in quarters.
QUARTILES = (("q1", 1), ("median", 2), ("q3", 3))
_STATE = "struct<percent:int,c:double,mean:double,m2:double,m3:double,m4:double,hi:double>"


def slice_size(n: Column, percent: Column) -> Column:
    """Smallest whole number of values that make up ``percent`` of n."""
    return F.floor((n * percent + 99) / 100).cast("long")


def _large(df: DataFrame, by: list[str], value: str, large: int | None) -> DataFrame | None:
    return None if large is None else ranges.large_groups(ranges.group_rows(df.filter(finite(value).isNotNull()), by), by, large)


def _ranked_ranges(df: DataFrame, by: list[str], value: str, tie: str, hot: DataFrame, large: int) -> DataFrame:
    rows = df.select(*by, tie, finite(value).alias("v")).filter("v is not null")
    return ranges.numbered(rows, by, ["v", tie], hot, large)


def ranked(df: DataFrame, by: list[str], value: str, tie: str, empty: bool = False, large: int | None = ranges.LARGE) -> DataFrame:
    """Finite values with their rank from 1 and the size of their group; with ``empty`` the other rows too, last.

    Groups with more than ``large`` values are ranked by ranges over many tasks, without their other rows. None: the caller
    knows that there is no such group.
    """
    hot = _large(df, by, value, large)
    if hot is None:
        return _ranked(df, by, value, tie, empty)
    rest, rows = ranges.parted(df, by, hot)
    return _ranked(rest, by, value, tie, empty).unionByName(_ranked_ranges(rows, by, value, tie, hot, large))


def _ranked(df: DataFrame, by: list[str], value: str, tie: str, empty: bool) -> DataFrame:
    rows = df.select(*by, tie, finite(value).alias("v"))
    w = Window.partitionBy(*by)
    out = (rows if empty else rows.filter("v is not null")).withColumn("rn", F.row_number().over(w.orderBy(F.col("v").asc_nulls_last(), tie)))
    return out.withColumn("n", F.count("v").over(w))


def _first_percent(rank: Column, percents: tuple[int, ...]) -> Column:
    """The first percent whose slice of the group's n values holds ``rank``, n * percent >= 100 * rank - 99; null if none does."""
    n, least, steps = F.col("n"), percents[0], {b - a for a, b in zip(percents, percents[1:], strict=False)}
    if list(percents) != sorted(percents) or len(steps) > 1:
        return F.coalesce(*[F.when(n * p >= 100 * rank - 99, F.lit(p)) for p in sorted(percents)])
    step = steps.pop() if steps else 1
    p = (least + step * F.greatest(F.lit(0), F.ceil(F.try_divide(100 * rank - 99 - n * least, n * step)))).cast("int")
    return F.when((n > 0) & (p <= percents[-1]), p)


def _quoted(percents: tuple[int, ...]) -> Column:
    """Whether some slice's quartile may lie next to the rank ``rn``: position a * k / 4 - 1/2 from rn - 2 to rn."""
    rn = F.col("rn").cast("long")
    near = rn == 1
    for _, a in QUARTILES:
        k = slice_size(F.col("n"), _first_percent(F.floor((4 * rn - 7 + a) / a), percents))
        near = near | (a * k < 4 * rn + 2)
    return near


def _merged(a: Column, b: Column) -> Column:
    """Central moments of two disjoint sets of values as those of both."""
    na, nb, d = a["c"], b["c"], b["mean"] - a["mean"]
    n = na + nb
    m2 = a["m2"] + b["m2"] + d * d * na * nb / n
    m3 = a["m3"] + b["m3"] + d * d * d * na * nb * (na - nb) / (n * n) + 3 * d * (na * b["m2"] - nb * a["m2"]) / n
    m4 = a["m4"] + b["m4"] + d * d * d * d * na * nb * (na * na - na * nb + nb * nb) / (n * n * n)
    m4 = m4 + 6 * d * d * (na * na * b["m2"] + nb * nb * a["m2"]) / (n * n) + 4 * d * (na * b["m3"] - nb * a["m3"]) / n
    fields = {"percent": b["percent"], "c": n, "mean": a["mean"] + d * nb / n, "m2": m2, "m3": m3, "m4": m4, "hi": b["hi"]}
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def _slice_stats(base: DataFrame, by: list[str], percents: tuple[int, ...]) -> DataFrame:
    """(by, percent, n, k, moments, quartiles): a row counts in the first slice that holds it, and the parts are merged.

    The values next to quartiles, six for each percent at most, are gathered apart.
    """
    v, c = F.col("v"), F.count("v").cast("double")
    m2 = F.var_pop(v) * c
    m3 = F.coalesce(F.skewness(v) * F.pow(m2, F.lit(1.5)) / F.sqrt(c), F.lit(0.0))
    m4 = F.coalesce((F.kurtosis(v) + 3) * m2 * m2 / c, F.lit(0.0))
    rows = base.select(*by, "v", "n", _first_percent(F.col("rn").cast("long"), percents).alias("percent"))
    parts = rows.groupBy(*by, "percent").agg(F.max("n").alias("n"), c.alias("c"), F.avg(v).alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"), F.max(v).alias("hi"))
    part = F.when(F.col("percent").isNotNull(), F.struct("percent", "c", "mean", "m2", "m3", "m4", "hi"))
    groups = parts.groupBy(*by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(part)).alias("parts"))
    picks = base.filter(_quoted(percents)).groupBy(*by).agg(F.collect_list(F.struct(F.col("rn").cast("long").alias("rn"), "v")).alias("picks"))
    groups = groups.join(picks, by)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    grow = lambda acc, b: F.concat(acc, F.array(F.when(F.size(acc) == 0, b).otherwise(_merged(last(acc), b))))
    groups = groups.select(*by, "n", F.map_from_entries("picks").alias("at"), F.aggregate("parts", F.array().cast(f"array<{_STATE}>"), grow).alias("states"))
    out = groups.select("*", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"))
    out = out.withColumns({"k": slice_size(F.col("n"), F.col("percent")), "s": last(F.filter("states", lambda s: s["percent"] <= F.col("percent")))})

    k, s = F.col("k"), F.col("s")
    lo, hi = F.col("at")[F.lit(1).cast("long")], s["hi"]
    shaped = (s["c"] >= 2) & (hi - lo > LEAST_RANGE * F.greatest(F.abs(lo), F.abs(hi)))
    found = {"mean": s["mean"], "sd": F.when(lo == hi, F.lit(0.0)).otherwise(F.sqrt(s["m2"] / s["c"]))}
    found["skewness"] = F.when(shaped, F.try_divide(F.sqrt(s["c"]) * s["m3"], F.pow(s["m2"], F.lit(1.5))))
    found["kurtosis"] = F.when(shaped, F.try_divide(s["c"] * s["m4"], s["m2"] * s["m2"]) - 3)
    found |= {"minimum": lo, "maximum": hi}
    for name, a in QUARTILES:
        # position q * k - 0.5, from 0
        pos = F.lit(a / 4) * k - 0.5
        low = F.greatest(F.lit(0), F.least(F.floor(pos), k - 1))
        x, y = F.col("at")[low + 1], F.col("at")[F.least(low + 1, k - 1) + 1]
        share = F.greatest(F.lit(0.0), F.least(pos, (k - 1).cast("double"))) - low
        found[name] = x + share * (y - x)
    return out.select(*by, "percent", "n", "k", *[c.alias(name) for name, c in found.items()])


def slices(df: DataFrame, by: list[str], value: str, tie: str, percents: tuple[int, ...] = PERCENTS, keep_outliers: bool = False, empty: bool = False, large: int | None = ranges.LARGE, rows: int | None = None) -> DataFrame:
    """For each group and percent, statistics of its k smallest finite values; percent 100 is the box plot A8.

    Both passes work on the partitions of the ranking: values are shuffled once, and no row is repeated for the percents
    that hold it. Groups without a finite value give no row, or with ``empty`` rows with n and k 0. ``large``: as in
    ``ranked``; no such group is held by one task. ``rows``: about how many ``df`` has, if the caller knows, so that no task
    gets more of them as tables grow.
    """
    hot = _large(df, by, value, large)
    df = df if hot is not None else ranges.spread(df, by, rows)
    if hot is None:
        return _slices(df, by, value, tie, percents, keep_outliers, empty)
    known = rows
    rest, rows = ranges.parted(df, by, hot)
    split = _range_slices(_ranked_ranges(rows, by, value, tie, hot, large), by, percents, keep_outliers)
    return _slices(ranges.spread(rest, by, known), by, value, tie, percents, keep_outliers, empty).unionByName(split)


def _range_slices(base: DataFrame, by: list[str], percents: tuple[int, ...], keep_outliers: bool) -> DataFrame:
    """``slices`` of large groups: each pass is an aggregate over the stored ranges, combined on the map side."""
    stats = _slice_stats(base, by, percents)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fence = F.struct("percent", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"), "k")
    fences = stats.groupBy(*by).agg(F.sort_array(F.collect_list(fence)).alias("__fences"))
    v, rn, second, entries = F.col("v"), F.col("rn"), [], []
    for i, p in enumerate(sorted(percents)):
        f = F.col("__fences")[i]
        held = rn <= f["k"]
        inside = held & (v >= f["low"]) & (v <= f["high"])
        found = {"whisker_low": F.min(F.when(inside, v)), "whisker_high": F.max(F.when(inside, v)), "first": F.min(F.when(inside, rn)), "last": F.max(F.when(inside, rn))}
        if keep_outliers:
            found["outlier_values"] = F.sort_array(F.collect_list(F.when(held & ~inside, v)))
        second += [c.alias(f"__{name}_{p}") for name, c in found.items()]
        entries.append(F.struct(F.lit(p).alias("percent"), *[F.col(f"__{name}_{p}").alias(name) for name in found]))
    marks = ranges.joined(base, by, fences).groupBy(*by).agg(*second).select(*by, F.explode(F.array(*entries)).alias("__m"))
    marks = marks.select(*by, "__m.*")
    out = ranges.joined(stats, [*by, "percent"], marks)
    outliers = F.col("k") - (F.col("last") - F.col("first") + 1)
    return out.select(*stats.columns, "whisker_low", "whisker_high", outliers.alias("outliers"), *(["outlier_values"] if keep_outliers else []))


def _slices(df: DataFrame, by: list[str], value: str, tie: str, percents: tuple[int, ...], keep_outliers: bool, empty: bool) -> DataFrame:
    base = _ranked(df, by, value, tie, empty)
    stats = _slice_stats(base, by, percents)
    found = [c for c in stats.columns if c not in by]
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    stats = stats.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    below, above = F.when(F.col("minimum") < F.col("low"), F.col("low")), F.when(F.col("maximum") > F.col("high"), F.col("high"))
    bounds = {"__low": F.min(below), "__low_to": F.max(below), "__high": F.min(above), "__high_to": F.max(above)}
    # stats go with the row of rank 1; other rows matter only where a fence that has values beyond it may lie beside them
    fences = stats.groupBy(*by).agg(F.collect_list(F.struct(below.alias("low"), above.alias("high"), F.struct(*found).alias("stats"))).alias("fences"), *[c.alias(k) for k, c in bounds.items()])
    w = Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_last(), tie)
    v, rn, prev, next_ = F.col("v"), F.col("rn"), F.col("__prev"), F.col("__next")
    low, low_to, high, high_to = (F.col(c) for c in bounds)
    beside = ((prev < low_to) & (v >= low)) | ((v <= high_to) & (next_ > high))
    beside = beside | (v < low_to) | (v > high) if keep_outliers else beside
    fenced = base.withColumns({"__prev": F.lag("v").over(w), "__next": F.lead("v").over(w)}).join(fences, by).filter((rn == 1) | beside)

    def marks(f: Column) -> Column:
        edge = ((prev < f["low"]) & (v >= f["low"])) | ((v <= f["high"]) & (next_ > f["high"]))
        edge = edge | (v < f["low"]) | (v > f["high"]) if keep_outliers else edge
        return (rn == 1) | ((rn <= f["stats"]["k"]) & edge)

    fenced = fenced.select(*by, "v", "rn", F.explode(F.filter("fences", marks)).alias("f"))
    outside = F.coalesce(v < F.col("f.low"), F.lit(False)) | F.coalesce(v > F.col("f.high"), F.lit(False))
    second = [F.min(F.when(~outside, v)).alias("whisker_low"), F.max(F.when(~outside, v)).alias("__high"), F.min(F.when(~outside, rn)).alias("__first"), F.max(F.when(~outside, rn)).alias("__last")]
    if keep_outliers:
        second.append(F.sort_array(F.collect_list(F.when(outside, v))).alias("outlier_values"))
    out = fenced.groupBy(*by, F.col("f.stats.percent").alias("percent")).agg(F.first("f.stats").alias("s"), F.first("f.high").alias("__fence"), *second)
    whole = F.col("__fence").isNull()
    whisker = F.when(whole, F.col("s.maximum")).otherwise(F.col("__high"))
    outliers = F.col("s.k") - F.when(whole, F.col("s.k")).otherwise(F.col("__last").cast("long")) + F.when(F.col("s.n") > 0, F.col("__first") - 1).otherwise(0)
    return out.select(*by, *[f"s.{c}" for c in found], "whisker_low", whisker.alias("whisker_high"), outliers.cast("long").alias("outliers"), *(["outlier_values"] if keep_outliers else []))


def box_plot(df: DataFrame, by: list[str], value: str, tie: str, keep_outliers: bool = False, large: int | None = ranges.LARGE) -> DataFrame:
    """The five numbers, whiskers and outliers of all finite values of each group."""
    return slices(df, by, value, tie, (100,), keep_outliers, large=large).drop("percent", "k")


def lowest(df: DataFrame, by: list[str], value: str, tie: str, percent: int, large: int | None = ranges.LARGE) -> DataFrame:
    """The values of one slice."""
    return ranked(df, by, value, tie, large=large).filter(F.col("rn") <= slice_size(F.col("n"), F.lit(percent))).drop("rn", "n")
