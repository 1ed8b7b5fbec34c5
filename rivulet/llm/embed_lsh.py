"""Operator 3: embedding near-duplicates by Euclidean p-stable hashing.

Vectors are scaled to length one and projected on Gaussian directions; a projection, shifted and divided by ``width``,
is rounded down, and ``hashes`` of them make a bucket in each of ``tables`` tables. Rows that share a bucket are
compared by exact cosine in double precision. Equal vectors are one class with a weight, so a hot vector costs one row.
A bucket of any size is cut into blocks and every pair of blocks is compared in a task of its own, so nothing is capped;
a task returns one row for each vector with links (their number and its local component), never pairs. A pair that
meets in several tables counts in the first of them only, and of buckets with the same members only the first is looked at.

At the limit (cosine 0.9) a pair is missed with probability (1 - p**hashes)**tables, p the chance of one equal value:
about 0.014 with the defaults, and below 1e-5 from cosine 0.95. The rounded projections are integers below 2**53, so
every task gets the same buckets for a vector.

Rows of a hot vector, bucket or component are joined without being gathered (``join_counted``); rows meet their class by a
128-bit hash of the vector, which is not shuffled with them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their
own component; vectors of different length never link; ties on the id cannot arise between distinct ids; rows that repeat
an id and a vector are counted as vectors of their own; null ids link nothing but are counted; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import join_counted, key_runs, mixed, stored
from rivulet.llm.graph import components

TABLES, HASHES, WIDTH = 96, 16, 2.0
BLOCK = 2048
_UNIT, _DIRECTION = 1 << 15, 1 << 12


def scaled(rows: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision from equally long rows of doubles."""
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Hashing:
    """Bucket keys of unit vectors; the same in every task."""

    def __init__(self, tables: int, hashes: int, width: float, seed: int):
        self.tables, self.hashes, self.width, self.seed = tables, hashes, width, seed
        self.drawn: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        dim = unit.shape[1]
        if dim not in self.drawn:
            rng = np.random.default_rng([self.seed, dim])
            directions = np.rint(rng.standard_normal((dim, self.tables * self.hashes)) * _DIRECTION)
            self.drawn[dim] = directions, rng.uniform(0, self.width, self.tables * self.hashes), rng.integers(1, 1 << 63, self.hashes, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        directions, shift, odd = self.drawn[dim]
        out = []
        for i in range(0, len(unit), 512):
            values = np.rint(unit[i : i + 512] * _UNIT) @ directions / (_UNIT * _DIRECTION)
            cells = np.floor((values + shift) / self.width).astype(np.int64).astype(np.uint64).reshape(-1, self.tables, self.hashes)
            table = np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)
            out.append(mixed(mixed((cells * odd).sum(axis=2)) + table))
        return np.concatenate(out) if out else np.zeros((0, self.tables), np.uint64)


def _classes(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(id, rep, n) for every row, rep null if it cannot link; (rep, n, vec) for every distinct vector."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    vec = F.when(fit, F.transform(v, lambda x: x + F.lit(0.0)))
    rows = vectors.select(F.col(key).alias("id"), vec.alias("vec")).select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), "vec")
    linked = rows.filter("vec is not null and id is not null").groupBy("h1", "h2")
    classes = stored(linked.agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")))
    fitted = F.col("vec").isNotNull() & F.col("id").isNotNull()
    keys = stored(rows.select("id", *[F.when(fitted, F.col(c)).alias(c) for c in ("h1", "h2")]))
    members = join_counted(keys, classes.select("h1", "h2", "rep", "n"), ["h1", "h2"], "n", keys.count(), "left")
    return members.select("id", "rep", F.coalesce("n", F.lit(1)).alias("n")), classes.select("rep", "n", "vec")


def _compare(hashing: Hashing, least: float, run: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, root) of the vectors of one bucket, or pair of blocks of it, that have links."""
    table, rep, n = run["table"][0].as_py(), run["rep"].to_numpy(), run["n"].to_numpy()
    unit = scaled([x.as_py() for x in run["vec"]])
    block = run["block"].to_numpy()
    first, second = run["i"][0].as_py(), run["j"][0].as_py()
    left = np.flatnonzero(block == first)
    right = np.flatnonzero(block == second)
    pairs = []
    for a in range(0, len(left), 512):
        rows = left[a : a + 512]
        x, y = np.nonzero(unit[rows] @ unit[right].T >= least)
        x, y = rows[x], right[y]
        ok = x < y if first == second else slice(None)
        pairs.append((x[ok], y[ok]))
    x, y = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    links = np.zeros(len(rep), np.int64)
    root = rep.copy()
    hit = np.unique(np.concatenate([x, y]))
    keys, at = hashing.keys(unit[hit])[:, :table], np.zeros(len(rep), np.int64)
    at[hit] = np.arange(len(hit))
    for a in range(0, len(x), 4096):
        p, q = x[a : a + 4096], y[a : a + 4096]
        new = ~(keys[at[p]] == keys[at[q]]).any(axis=1)
        np.add.at(links, p[new], n[q[new]])
        np.add.at(links, q[new], n[p[new]])
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, low[x])
        if (low == root).all():
            break
        root = low
    return rep[hit], links[hit], root[hit]


def near_duplicates(vectors: DataFrame, least: float = 0.9, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, block: int = BLOCK, seed: int = 1, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    members, classes = _classes(vectors, key, column)
    hashing = Hashing(tables, hashes, width, seed)

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lists = batch.column("vec")
        sizes = np.diff(lists.offsets.to_numpy())
        values = lists.values.to_numpy()
        start = lists.offsets.to_numpy()[:-1]
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            yield rows, values[start[rows][:, None] + np.arange(d)]

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column("rep").to_numpy()
            for rows, x in by_length(batch):
                for a in range(0, len(rows), 1024):
                    k = hashing.keys(scaled([r.tobytes() for r in np.ascontiguousarray(x[a : a + 1024])]))
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64).ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(k))), pa.array(np.repeat(rep[rows[a : a + 1024]], tables))], ["key", "table", "rep"])

    keyed = stored(classes.mapInArrow(buckets, "key long, table int, rep long"))
    set_of = [F.bit_xor(F.xxhash64(F.lit(i), "rep")).alias(f"set{i}") for i in range(2)]
    shared = keyed.groupBy("key", "table").agg(F.count(F.lit(1)).alias("size"), *set_of).filter("size > 1")
    # buckets with the same members: the first table has all their pairs
    shared = shared.groupBy("size", "set0", "set1").agg(F.min(F.struct("table", "key")).alias("b")).select("b.key", "b.table", "size")
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = join_counted(keyed, stored(shared), ["key", "table"], "size", keyed.count()).withColumn("blocks", blocks).withColumn("block", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "table", "block", "rep")
    packed = F.col("vec")
    rows = rows.join(classes.select("rep", "n", packed), "rep").select("key", "i", "j", "table", "block", "rep", "n", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "links", "root"]
        for run in key_runs(map(as_bytes, batches), 3):
            if len(run) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _compare(hashing, least, run)], names)

    def as_bytes(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("vec")
        off, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        vec = pa.array([values[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], vec], batch.schema.names)

    found = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "rep long, links long, root long")
    found = stored(found.groupBy("rep", "root").agg(F.sum("links").alias("links")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # links and components come to each class, and with it to all copies of its vector
    per = stored(classes.select("rep", F.col("n").alias("copies")).join(links, "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left"))
    members = stored(members)
    out = join_counted(members, per, ["rep"], "copies", members.count(), "left")
    component = F.coalesce("component", "rep", "id")
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return out.select(F.col("id").alias(key), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
