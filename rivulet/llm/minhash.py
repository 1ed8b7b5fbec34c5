"""Operator 2: near-duplicate texts by b-bit MinHash.

``signatures`` takes, for each whole text, the set of its distinct word shingles, the minima of that set under
``BANDS * ROWS`` permutations, the band keys made of the full minima, and a packed signature with the low two bits of
every minimum. Texts with equal sets are one class, represented by its smallest id. Representatives that share a band
key are candidates; the packed signatures estimate their similarity from bit counts, corrected for the collisions that
two-bit values have by chance; candidates of at least ``FILTER`` are confirmed on their full sets.

No bucket is capped and no bucket's pairs are all listed. First, every member is confirmed against the smallest id of
each of its buckets. Then only buckets that still hold several components list pairs, those across components, and
large ones in blocks; the few documents in them get a longer signature, and a pair is listed under one key only and if
both signatures put it near the limit. Both steps together link whatever candidates are similar enough, and
components depend on that alone.

A pair of similarity 0.8 shares no band with probability (1 - 0.8**ROWS)**BANDS, about 5e-8; its estimate falls below
the least with probability 1e-6 or less.

Defined cases: null text or text without words has an empty set and links with nothing; with fewer words than a shingle
the whole sequence is the one shingle; a long text is hashed in runs of words, its set held whole; of rows that repeat an
id, the one with the smallest set (then set hash, then text hash) stands for the id, and every row gets its result; a row
with null id links with nothing, its component is null and it is kept; an empty table gives an empty result; other
columns are ignored, whatever their names. ``drop_duplicates`` carries them along and keeps one row of each id.

Copies of one text, members of one bucket and leaves of one hub may be a third of all rows: their joins broadcast the
rows of such hot keys, of which there is a bounded number (``join_counted``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import LOWER, join_counted, mixed, pieces, stored, unused, word_hashes
from rivulet.llm.graph import components

BANDS, ROWS = 32, 4
BITS = 2
#: Least estimate of a candidate: 4.7 standard deviations or more below 0.8, for BANDS * ROWS and for FINE values.
FILTER = 0.55
FINE, FINE_FILTER = 1536, 0.742
#: Members of one hub that meet it in one task, and rows of one block of a bucket.
GROUP, BLOCK = 64, 1000


def shingle_sets(col: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text."""
    step = np.uint64(0xD6E8FEB86659FD93)
    for _, off, data in pieces(col):
        words, at = word_hashes(LOWER[data], off)
        n = len(words)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * step + words[k : k + len(rolled)]
        rolled = mixed(rolled)
        for i in range(len(off) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for k in range(a, b):
                    whole = whole * step + words[k : k + 1]
                yield mixed(whole)
            else:
                yield np.zeros(0, np.uint64)


class Permutations:
    """Minima of 32-bit values under random linear permutations."""

    def __init__(self, n: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, n, dtype=np.int64).astype(np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.int64).astype(np.uint32)[:, None]

    def minima(self, values: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(values), 2048):
            part = self.a * values[None, i : i + 2048]
            part += self.b
            part ^= part >> np.uint32(15)
            np.minimum(low, part.min(axis=1), out=low)
        return low


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of minima, in 64-bit words."""
    place = (np.arange(len(low), dtype=np.uint64) * np.uint64(BITS)) % np.uint64(64)
    bits = (low.astype(np.uint64) & np.uint64((1 << BITS) - 1)) << place
    return np.bitwise_or.reduce(bits.reshape(-1, 64 // BITS), axis=1)


def fine_signatures(texts: DataFrame, width: int, values: int = FINE) -> DataFrame:
    """(id, f0...): packed signatures of ``values`` minima."""
    longs = values * BITS // 64
    names = ["id", *(f"f{i}" for i in range(longs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = Permutations(values, seed=3)
        for batch in batches:
            sigs = [packed(draw.minima((s >> np.uint64(32)).astype(np.uint32))) for s in shingle_sets(batch.column(1), width)]
            sig = np.array(sigs, np.uint64).reshape(-1, longs).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sig[:, i].copy()) for i in range(longs))], names)

    return texts.select("id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def signatures(docs: DataFrame, width: int = 4, bands: int = BANDS, rows: int = ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, t, n, h1, h2, s0..., bands): text hash, set size, two set hashes, packed signature, band keys."""
    longs = bands * rows * BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = Permutations(bands * rows)
        odd = np.random.default_rng(2).integers(1, 1 << 63, rows, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        number = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sizes, h1, h2, sigs, keys = [], [], [], [], []
            for s in shingle_sets(batch.column(2), width):
                sizes.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64)))
                h2.append(int(np.bitwise_xor.reduce(mixed(s + np.uint64(1)))) if len(s) else 0)
                low = draw.minima((s >> np.uint64(32)).astype(np.uint32)).astype(np.uint64)
                sigs.append(packed(low))
                keys.append(mixed((low.reshape(bands, rows) * odd).sum(axis=1, dtype=np.uint64) + number))
            sig = np.array(sigs, np.uint64).reshape(-1, longs).view(np.int64)
            flat = np.array(keys, np.uint64).reshape(-1).view(np.int64)
            band = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)), *(pa.array(sig[:, i].copy()) for i in range(longs)), band]
            yield pa.RecordBatch.from_arrays(columns, ["id", "t", "n", "h1", "h2", *(f"s{i}" for i in range(longs)), "bands"])

    kinds = ", ".join(f"s{i} long" for i in range(longs))
    return docs.select(F.col(key).cast("long"), F.xxhash64(text), text).mapInArrow(run, f"id long, t long, n long, h1 long, h2 long, {kinds}, bands array<long>")


def estimate(a: list[Column], b: list[Column], n: int) -> Column:
    """Collision-corrected similarity of two packed two-bit signatures of ``n`` values."""
    same = F.lit(0)
    for x, y in zip(a, b, strict=True):
        d = x.bitwiseXOR(y)
        same = same + F.bit_count(F.bitwise_not(d.bitwiseOR(F.shiftrightunsigned(d, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 1 / (1 << BITS)
    return (same / n - chance) / (1 - chance)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b; a stored table) whose full sets have 100 * intersection >= percent * union."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / GROUP)).cast("int")
    members = stored(join_counted(pairs, sizes, ["a"], "size", pairs.count()).select("a", part.alias("part"), F.col("b").alias("id")))
    work = members.unionByName(members.select("a", "part", F.col("a").alias("id")).distinct())
    rows = work.join(texts.select("id", "text"), "id").select("a", "part", (F.col("a") != F.col("id")).alias("leaf"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a hub comes before its leaves; only its set is held
        hub, own = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            hubs, leaf, ids = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for i, s in enumerate(shingle_sets(batch.column(4), width)):
                if not leaf[i]:
                    hub, own = hubs[i], s
                elif hub == hubs[i]:
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(s) - common):
                        found.append((hub, ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], ["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "leaf").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every document."""
    out = _components(docs, width, percent, bands, rows, text, key)
    component = F.col("component")
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _components(docs: DataFrame, width: int, percent: int, bands: int, rows: int, text: str, key: str) -> DataFrame:
    """(id, t, n, chosen, component) for every row; chosen: the text hash of the row that stands for the id."""
    signed = stored(signatures(docs, width, bands, rows, text, key))
    longs = [c for c in signed.columns if c[0] == "s"]
    n_rows = signed.count()
    ids = signed.filter("id is not null").groupBy("id").agg(F.min(F.struct("n", "h1", "h2", "t")).alias("c"), F.count(F.lit(1)).alias("rows"))
    ids = stored(ids.select("id", "c.*", "rows"))
    filled = ids.filter("n > 0")
    classes = filled.groupBy("n", "h1", "h2").agg(F.min(F.struct("id", "t")).alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = stored(classes.select("n", "h1", "h2", "size", F.col("rep.id").alias("rep"), F.col("rep.t").alias("t")))
    reps = signed.join(classes.select(F.col("rep").alias("id"), "t"), ["id", "t"], "left_semi").dropDuplicates(["id"])
    reps = stored(reps.select("id", "t", *longs, "bands"))
    short = reps.select("id", *longs)
    keyed = reps.select("id", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    n_keyed = bands * reps.count()
    shared = stored(join_counted(keyed, hubs, ["key"], "size", n_keyed))
    alike = lambda p: estimate([F.col(f"a{c}") for c in longs], [F.col(f"b{c}") for c in longs], bands * rows) >= FILTER
    side = lambda x: short.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}{c}") for c in longs])
    pairs = stored(shared.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    leaves = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size")).join(side("a"), "a")
    pairs = join_counted(pairs, leaves, ["a"], "size", pairs.count()).join(side("b"), "b")
    pairs = stored(pairs.filter(alike(None)).select("a", "b"))
    # texts of all that may still be compared
    wanted = shared.select("id").distinct().join(reps.select("id", "t"), "id")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    texts = stored(texts.join(wanted, ["id", "t"], "left_semi").dropDuplicates(["id"]))
    links = stored(confirmed(pairs, texts, width, percent))
    first = stored(components(links))
    # buckets that hold several components: pairs across them
    known = shared.select("id", "key", "size").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    known = stored(known)
    split = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members")).filter("low <> high").select("key", "members")
    open_keys = stored(join_counted(known, split, ["key"], "members", n_keyed).drop("members"))
    per = open_keys.groupBy("id").agg(F.collect_set("key").alias("keys"))  # BANDS keys at most
    fine = fine_signatures(texts.join(per, "id", "left_semi"), width)
    fines = [c for c in fine.columns if c != "id"]
    looks = stored(per.join(short, "id").join(fine, "id"))
    open_rows = open_keys.join(looks, "id")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = lambda x: [F.col("comp").alias(f"{x}comp"), F.col("id").alias(x), F.col("keys").alias(f"{x}keys"), *[F.col(c).alias(f"{x}{c}") for c in [*longs, *fines]]]
    left = open_rows.select("key", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), *own("a"))
    right = open_rows.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *own("b"))
    close = estimate([F.col(f"a{c}") for c in fines], [F.col(f"b{c}") for c in fines], FINE) >= FINE_FILTER
    once = left["key"] == F.array_min(F.array_intersect("akeys", "bkeys"))
    across = left.join(right, (left["key"] == right["key"]) & (left["block"] == right["block"]) & (F.col("acomp") < F.col("bcomp")) & alike(None) & close & once)
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(pairs, ["a", "b"], "left_anti")
    more = stored(confirmed(stored(across), texts, width, percent))
    comps = components(links.unionByName(more))
    # the component comes to each class, and with it to all copies of its text
    found = classes.select("n", "h1", "h2", "size", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("n", "h1", "h2", "size", F.coalesce("component", "rep").alias("component"))
    member = join_counted(ids.drop("rows"), stored(found), ["n", "h1", "h2"], "size", n_rows, "left").drop("size")
    member = member.select("id", F.col("n"), F.col("t").alias("chosen"), F.coalesce("component", "id").alias("component"))
    if n_rows == ids.count():  # one row for each id
        return member.select("id", F.col("chosen").alias("t"), "n", "chosen", "component")
    each = signed.select("id", "t", F.col("n").alias("own_n"))
    out = join_counted(each, member.join(ids.select("id", "rows"), "id"), ["id"], "rows", n_rows, "left")
    return out.select("id", "t", F.coalesce("n", "own_n").alias("n"), "chosen", "component")


def drop_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component; rows with null id stay."""
    found = stored(_components(docs, width, percent, BANDS, ROWS, text, key))
    gone, hash_ = unused(docs, "gone"), unused(docs, "hash")
    keep = found.filter("id is not null").groupBy("id").agg(F.max(F.col("id") == F.col("component")).alias("kept"), F.max("chosen").alias(hash_), F.count(F.lit(1)).alias("rows"))
    keep = stored(keep)
    own = F.col(key).cast("long")
    # a sort-merge join whatever the sizes: the plan is the same on any input
    rows = docs.join(keep.filter("not kept").select(F.col("id").alias(gone)).hint("merge"), own == F.col(gone), "left_anti")
    several = keep.filter("kept and rows > 1").select(F.col("id").alias(gone), hash_)
    if several.isEmpty():
        return rows
    once = rows.join(several.select(gone), own == F.col(gone), "left_anti")
    one = rows.join(several, (own == F.col(gone)) & (F.xxhash64(text) == F.col(hash_))).dropDuplicates([gone])
    return once.unionByName(one.select(*docs.columns))
