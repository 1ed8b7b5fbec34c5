"""Shared pieces: byte views of whole texts, hashed grams, and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as Java and RE2 patterns take it.
SPACE = r"[\x20\x09-\x0D]"
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 9, 10, 11, 12, 13]] = True
#: ASCII capitals to small letters; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that a task works on at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19


#: A key with more rows than ``1 / HOT_KEYS`` of all, and than ``HOT_ROWS``, is hot; so there are fewer than ``HOT_KEYS``.
HOT_KEYS, HOT_ROWS = 10_000, 100
#: The folder that new scratch tables go to, inside ``cleared``.
_owner: ContextVar[str | None] = ContextVar("scratch folder", default=None)


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only where that is unset on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rivulet-")
    return f"{base.rstrip('/')}/rivulet-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a scratch folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at its end: write or store what is still needed of the result before."""
    folder = scratch(spark)
    token = _owner.set(folder)
    try:
        yield
    finally:
        _owner.reset(token)
        discard(spark, folder)


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written as a shared table and read again: lineage ends here and lost executors cost nothing."""
    owner = _owner.get()
    path = f"{owner}/{uuid.uuid4().hex}" if owner else scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, per: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` (``total`` of them, a stored table) joined with ``per``, one row for each key and its number of rows, ``size``.

    The rows of a hot key stay in the tasks that read them: fewer than ``HOT_KEYS`` rows of ``per`` are broadcast for
    them. All others are shuffled by key, and none of those has more than its bounded share of the rows.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = per.filter(F.col(size) > limit)
    there = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(per.filter(F.col(size) <= limit), keys, how)
    return there.unionByName(rest)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that have one of ``names``, those of the columns that an operator adds."""
    added = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in added])


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def id_mod(key: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by`` (null id: 0)."""
    return F.coalesce(F.crc32(key.cast("string")) % by, F.lit(0))


def bounded_texts(slim: DataFrame, docs: DataFrame, text: str, label: str, rows: int) -> DataFrame:
    """(label, text, times): at most ``rows`` labelled texts, all if there are no more, for a model to be fitted on.

    ``slim`` has (label, h), a row for each labelled text, h its xxhash64; ``docs`` has the texts. What is chosen depends
    on labels and texts alone, not on ids or on where rows lie: equal pairs count together and get their share of ``rows``,
    the rest of it by a hash, so that repeated rows are neither all taken nor all left. Only chosen texts are shuffled.
    """
    pairs = stored(slim.groupBy(label, "h").agg(F.count(F.lit(1)).alias("m")))
    total = pairs.agg(F.sum("m")).first()[0] or 0
    share = min(1.0, rows / max(1, total))
    whole, chance = F.floor(F.col("m") * share), F.pmod(F.xxhash64(F.lit("share"), label, "h"), F.lit(1 << 24)) / (1 << 24)
    times = whole + F.when(F.col("m") * share - whole > chance, 1).otherwise(0)
    order = F.xxhash64(F.lit("order"), label, "h")
    some = pairs.select(label, "h", times.cast("long").alias("times"), order.alias("o")).filter("times > 0").orderBy("o", label, "h").limit(rows)
    run = F.sum("times").over(Window.orderBy("o", label, "h"))  # over ``rows`` rows at most
    times = F.least(F.col("times"), F.lit(rows) - (run - F.col("times")))
    chosen = stored(some.withColumn("times", times).filter("times > 0").select(label, "h", "times"))
    found = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text")).join(F.broadcast(chosen.select("h").distinct()), "h").dropDuplicates(["h"])
    return found.join(F.broadcast(chosen), "h").select(label, "text", "times")


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and the UTF-8 bytes of a string column; null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off, raw


def pieces(col: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of whole texts of about ``limit`` bytes."""
    off, raw = column_bytes(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, off[i : j + 1] - off[i], raw[off[i] : off[j]]
        i = j


def gram_hash(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A ``bits``-bit hash of the ``n`` bytes that start at each place."""
    m = max(0, len(data) - n + 1)
    x = np.full(m, 0x811C9DC5 + n, np.uint32)
    for k in range(n):
        x = (x ^ data[k : k + m]) * np.uint32(0x01000193)
    x ^= x >> np.uint32(15)
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def window_sums(values: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """For each text, the sum of ``values`` over its ``n``-byte windows."""
    run = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    ends = np.minimum(np.maximum(off[1:] - n + 1, off[:-1]), len(run) - 1)
    return run[ends] - run[np.minimum(off[:-1], len(run) - 1)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def split_words(data: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[np.ndarray]:
    """A long text in runs of about ``limit`` bytes that end before white space."""
    at = 0
    while len(data) - at > limit:
        end, step = at + limit, 1 << 12
        while end < len(data) and not SPACE_BYTES[data[end : end + step]].any():
            end += step
        end = min(len(data), end + int(SPACE_BYTES[data[end : end + step]].argmax()))
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts in order, and each text's offsets into them."""
    if len(off) == 2 and len(data) > 2 * PIECE_BYTES:
        words = np.concatenate([word_hashes(x, np.array([0, len(x)]))[0] for x in split_words(data)])
        return words, np.array([0, len(words)])
    blank = SPACE_BYTES[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = blank[:-1]
    fresh[off] = True
    starts = np.flatnonzero(fresh[:-1] & ~blank)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    owner = np.cumsum(fresh[:-1] & ~blank) - 1
    place = np.where(owner >= 0, np.arange(len(data)) - starts[owner], 0)
    power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    part = (data.astype(np.uint64) + np.uint64(1)) * power[place]
    part[blank] = 0
    return mixed(np.add.reduceat(part, starts)), np.searchsorted(starts, off)


def gram_runs(data: np.ndarray, n: int, bits: int) -> Iterator[np.ndarray]:
    """``gram_hash`` of a long text in runs."""
    for a in range(0, len(data), PIECE_BYTES):
        yield gram_hash(data[a : a + PIECE_BYTES + n - 1], n, bits)


def key_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of one key each (the first ``keys`` columns, integers), from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(i)[-1].as_py() != columns[i][0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        starts = np.flatnonzero(change)
        if len(starts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(starts[0]))])
            held = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield pa.Table.from_batches([batch.slice(int(a), int(b - a))])
            held = [batch.slice(int(starts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
