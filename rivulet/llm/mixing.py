"""Operator 9 (native): mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources, ordered by code point with null last, share all words by repeating weights; a target stops at
``max_repeat`` times its source's size and the rest is shared again by weight. Blocks: the targets are cut into blocks
of ``block`` words, which go to sources by the highest quotients target / (2 j + 1); each source's blocks go to its
shards, of bounded size, by the same rule. Selection: a shard's documents, in a seeded order, form a stream of blocks; a
shard's quota takes whole rounds of the stream and then blocks from its start.

Rows that are alike in key, source and text are one document with a number of copies, counted before anything is shuffled:
its copies follow one another in the stream. A shard is chosen by key and text, so null or repeated keys spread.

Targets and the sources' own blocks are ranked in windows over one row, and about four quotients, for each source.

Defined cases: null text has size 0 and is never taken; a source of size 0 has target 0; a table without words, or
without rows, has targets 0; equal quotients go to the source or shard that sorts first; repeated rows and rows with a
null key count as documents of their own, copies one after another; further columns are ignored by ``mix`` and carried
along by ``apply_mix``, whatever their names, where equal rows share what they are taken. Rounding to blocks and the limit of
``max_repeat`` can leave a source short of its target by one block for each of its shards at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import SPACE, stored, unused

WEIGHTS = (5, 2, 1)
BLOCK = 16
#: Words of a shard, about: a source of any size is split into shards that one task can order.
SHARD_WORDS = 2_000_000
#: Copies of a document that one row is turned into at a time.
COPIES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """sources (source, source_size) with target; one row per source, so its windows order a small table."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    every = Window.partitionBy()
    s = s.withColumns({"total": F.sum("source_size").over(every), "weights": F.sum("weight").over(every)})
    # the sources that fill first are capped: level is the words per weight that the others then get
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), "total")


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: each group's seats by the highest quotients votes / (2 j + 1).

    A party's seats differ from its exact share by at most half a seat for each party of the group, weighed by the
    share, and one more; only the quotients in that range are ranked, about four for each party.
    """
    w = Window.partitionBy(*group)
    p = parties.withColumn("__share", F.coalesce(F.try_divide(F.col(votes).cast("double"), F.sum(votes).over(w).cast("double")), F.lit(0.0)))
    slack = F.col("__share") * F.count(F.lit(1)).over(w) / 2 + 1
    p = p.withColumn("__slack", slack)
    p = p.withColumn("__low", F.greatest(F.lit(0), F.floor(F.col(seats) * F.col("__share") - F.col("__slack"))))
    p = p.withColumn("__left", F.col(seats) - F.sum("__low").over(w))
    high = F.ceil(F.col(seats) * F.col("__share") + F.col("__slack"))
    p = p.withColumn("__j", F.explode(F.sequence(F.col("__low"), high)))
    quotient = F.when(F.col(votes) > 0, F.col(votes) / (2 * F.col("__j") + 1))
    best = Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), F.col(party).asc_nulls_last(), "__j")
    p = p.withColumn("__rank", F.row_number().over(best))
    won = F.sum(F.when((F.col("__rank") <= F.col("__left")) & (F.col(votes) > 0), 1).otherwise(0))
    return p.groupBy(*parties.columns).agg((F.first("__low") + won).cast("long").alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 1, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, taken) for every row."""
    found = _mixed(docs, weights, max_repeat, block, shard_words, seed, text, key, source)
    one = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("copy") * F.col("size")))
    return _copies(found).select(F.col("k").alias(key), F.col("source").alias(source), "size", "source_size", "target", one.cast("long").alias("taken"))


def _copies(rows: DataFrame, most: int = COPIES) -> DataFrame:
    """A row for each of its ``m`` copies, with ``copy`` from 0; those of many copies are spread over the tasks first."""
    few = rows.filter(F.col("m") <= most).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    runs = rows.filter(F.col("m") > most).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(most).cast("long"))))
    runs = runs.repartition("k", "source", "t", "from")
    many = runs.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + most, F.col("m")) - 1))).drop("from")
    return few.unionByName(many)


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_repeat: int, block: int, shard_words: int, seed: int, text: str, key: str, source: str) -> DataFrame:
    """(k, source, size, t, m, source_size, target, rounds, rest, before); t: hash of the text, m: its copies."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("t"), F.md5(name.cast("binary")).alias("order"))
    sized = stored(rows.groupBy("k", "source", "size", "t", "order").agg(F.count(F.lit(1)).alias("m")).withColumn("words", F.col("size") * F.col("m")))
    per = targets(sized.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeat)
    per = per.withColumn("seats", F.floor(F.col("total") / block))
    quotas = sainte_lague(per, ["seats"], "source", "target", "seats").select("source", "source_size", "target", F.least("quota", F.floor(F.col("source_size") * max_repeat / block)).alias("source_quota"))
    quotas = stored(quotas).withColumnRenamed("source", "__source")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    rows = sized.join(quotas, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % shards)
    sums = rows.groupBy("source", "shard", "source_quota").agg(F.sum("words").alias("shard_size"))
    dealt = sainte_lague(sums, ["source", "source_quota"], "shard", "shard_size", "source_quota")
    dealt = dealt.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "shard_size", (F.least("quota", F.floor(F.col("shard_size") * max_repeat / block)) * block).alias("taken"))
    rows = rows.join(dealt, F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source", "shard").orderBy("order", "k", "size", "t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("taken") / F.col("shard_size"))).otherwise(0)
    rows = rows.select("k", "source", "size", "t", "m", "source_size", "target", rounds.alias("rounds"), "taken", "shard_size", before.alias("before"))
    return rows.withColumn("rest", F.col("taken") - F.col("rounds") * F.col("shard_size")).drop("taken", "shard_size")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 1, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` as mixed: a row for each time that its document is taken, the last if at least half of it is."""
    id_, hash_, home, times = (unused(docs, c) for c in ("id", "hash", "home", "times"))
    found = _mixed(docs, weights, max_repeat, block, shard_words, seed, text, key, source)
    words = F.col("size") * F.col("m")
    part = F.try_divide(F.greatest(F.lit(0), F.least(words, F.col("rest") - F.col("before"))), words)
    share = F.floor(F.col("rounds") + F.coalesce(part, F.lit(0)) + 0.5).cast("int")
    found = found.filter("size > 0").select("k", "t", "source", share).toDF(id_, hash_, home, times).filter(F.col(times) > 0)
    same = F.col(key).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_)) & F.col(source).eqNullSafe(F.col(home))
    out = docs.join(found, same).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
