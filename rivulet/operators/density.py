"""Gaussian density curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.numeric import finite

LEAST_POINTS, MOST_POINTS = 1024, 16001
#: Values that one task sums at a time.
BLOCK_VALUES = 1 << 16
#: Groups that a task hands on at a time.
EMIT_ROWS = 64


def bandwidths(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, h, grid ends and number of points of every group; h null where no curve is defined."""
    v = finite(value)
    per = df.groupBy(*by).agg(F.count(v).alias("n"), F.stddev_pop(v).alias("sd"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))
    scale = F.greatest(F.lit(1.0), F.abs("minimum"), F.abs("maximum"))
    fit = (F.col("n") >= 2) & (F.col("sd") > 1e-12 * scale)
    per = per.withColumn("h", F.when(fit, F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))))
    per = per.withColumns({"from": F.col("minimum") - 6 * F.col("h"), "to": F.col("maximum") + 6 * F.col("h")})
    points = F.ceil(F.try_divide((F.col("to") - F.col("from")) * 5, F.col("h"))) + 1
    return per.withColumn("points", F.when(fit, F.least(F.lit(MOST_POINTS), F.greatest(F.lit(LEAST_POINTS), points))).cast("int"))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of batches sorted by their first columns; a key's rows may come in several parts, one after another."""
    for batch in batches:
        change = np.zeros(len(batch), bool)
        for c in batch.columns[:keys]:
            code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= code[1:] != code[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), len(batch)] if len(batch) else []
        for i, j in pairwise(starts):
            yield tuple(c[i].as_py() for c in batch.columns[:keys]), batch.slice(i, j - i)


def _kernels(x: np.ndarray, v: np.ndarray, times: np.ndarray, h: float) -> np.ndarray:
    out = np.zeros(len(x))
    for j in range(0, len(x), 2048):
        for i in range(0, len(v), 512):
            z = (x[j : j + 2048, None] - v[None, i : i + 512]) / h
            out[j : j + 2048] += np.exp(-0.5 * z * z) @ times[i : i + 512]
    return out


def _curve(raw: np.ndarray, a: float, b: float) -> np.ndarray:
    """Area one by the trapezoid rule."""
    return raw / ((raw.sum() - 0.5 * (raw[0] + raw[-1])) * (b - a) / (len(raw) - 1))


def _marks(raw: np.ndarray, a: float, b: float, low: float, high: float) -> np.ndarray:
    """Peak (place and height) of a curve, and its heights at the least and the greatest value."""
    y, x = _curve(raw, a, b), np.linspace(a, b, len(raw))
    ends = np.interp([low, high], x, y)
    return np.array([x[np.round(y, 12).argmax()], y.max(), *ends])


def _summed(df: DataFrame, by: list[str], value: str, block: int, finish: Callable[..., np.ndarray]) -> DataFrame:
    """(group, from, to, made): ``finish`` of every group's kernel sums (raw, from, to, minimum, maximum).

    A group's distinct values, with their counts, are dealt by their hash into blocks of about ``block``. A task sums the
    kernels of its blocks into one array for each group; a group of one block is finished there. The arrays of other
    groups are added one after another, so that a task holds one of them, whatever the number of blocks.
    """
    grid = bandwidths(df, by, value).filter("h is not null")
    rows = df.select(*by, (finite(value) + 0.0).alias("v")).filter("v is not null").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("times"))
    info = ["h", "from", "to", "points", "minimum", "maximum", "blocks"]
    rows = rows.join(grid.withColumn("blocks", F.ceil(F.col("n") / block)).select(*by, *info), by).select(*by, *info, "v", "times")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks"))).repartition(*by, "block").sortWithinPartitions(*by).drop("block")
    k = len(by)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, `from` double, `to` double, minimum double, maximum double, done boolean, made array<double>"

    def emitted(like: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        types = [*[like.schema.field(i).type for i in range(k)], *[pa.float64()] * 4, pa.bool_(), pa.list_(pa.float64())]
        columns = list(zip(*rows, strict=True)) or [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*by, "from", "to", "minimum", "maximum", "done", "made"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, raw, out, like = None, None, None, [], None

        def close() -> None:
            ends = told["from"], told["to"], told["minimum"], told["maximum"]
            whole = told["blocks"] == 1
            out.append((*now, *ends, whole, finish(raw, *ends) if whole else raw))

        for key, part in _runs(batches, k):
            like = part
            if key != now:
                if now is not None:
                    close()
                told = {c: part.column(k + i)[0].as_py() for i, c in enumerate(info)}
                now, raw, x = key, np.zeros(told["points"]), np.linspace(told["from"], told["to"], told["points"])
            v = part.column(k + len(info)).to_numpy()
            raw += _kernels(x, v, part.column(k + len(info) + 1).to_numpy().astype(float), told["h"])
            if len(out) >= EMIT_ROWS:
                yield emitted(part, out)
                out = []
        if now is not None:
            close()
        if out:
            yield emitted(like, out)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, raw, out, like = None, None, None, [], None
        for key, part in _runs(batches, k):
            like = part
            for i in range(len(part)):
                made = part.column(k + 5)[i].values.to_numpy()
                if part.column(k + 4)[i].as_py():
                    out.append((*key, *(part.column(k + j)[i].as_py() for j in range(4)), True, made))
                elif key == now:
                    raw = raw + made
                else:
                    if now is not None:
                        out.append((*now, *ends, True, finish(raw, *ends)))
                    now, ends, raw = key, [part.column(k + j)[i].as_py() for j in range(4)], made
            if len(out) >= EMIT_ROWS:
                yield emitted(part, out)
                out = []
        if now is not None:
            out.append((*now, *ends, True, finish(raw, *ends)))
        if out:
            yield emitted(like, out)

    return rows.mapInArrow(sums, schema).repartition(*by).sortWithinPartitions(*by).mapInArrow(added, schema).select(*by, "from", "to", "made")


def density(df: DataFrame, by: list[str], value: str, block: int = BLOCK_VALUES) -> DataFrame:
    """(group, i, x, density): a curve of area one for every group that has one."""
    curves = _summed(df, by, value, block, lambda raw, a, b, low, high: _curve(raw, a, b))
    step = (F.col("to") - F.col("from")) / (F.size("made") - 1)
    return curves.select(*by, "from", step.alias("step"), F.posexplode("made").alias("i", "density")).select(*by, "i", (F.col("from") + F.col("i") * F.col("step")).alias("x"), "density")


def density_summary(df: DataFrame, by: list[str], value: str, block: int = BLOCK_VALUES) -> DataFrame:
    """``bandwidths`` of every group with the curve's peak (place and height; the first of equal heights to 12 digits) and
    its heights at the least and the greatest value, between grid points on a straight line; nulls where there is no curve.

    The area of each curve is one, so the heights need no more scaling. Curves stay in the tasks: four numbers leave them.
    """
    found = _summed(df, by, value, block, _marks)
    marks = [F.get("made", F.lit(i)).alias(c) for i, c in enumerate(("peak_x", "peak", "at_minimum", "at_maximum"))]
    return bandwidths(df, by, value).join(found.select(*by, *marks), by, "left")
