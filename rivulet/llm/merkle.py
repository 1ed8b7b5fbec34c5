"""Operator 13: Merkle manifest of a dataset, with nested-interval labels.

Every row is a leaf, hashed from its columns. Leaves are ranked by key within their group (a source); a node carries the
interval [lo, hi) of the leaf ranks that it covers, its level and its digest. ``FANOUT`` neighbours of one level become
their parent while a group has more than one node; the last node is the group's subroot. The subroots, ranked by group,
are the leaves of one more tree, whose last node is the root.

Ancestors are attached from the root down: nodes of a level meet those of the level above in buckets of ``FANOUT ** level``
leaf ranks, where the parent is the node whose interval contains theirs. The siblings of a node are the intervals of its
parent without its own; a leaf's proof is the list of these, level by level. A bucket has ``FANOUT`` rows at most, whatever
the size of a group, and no step works on a group as a whole: ranks come from a range partitioning of all rows.

Everything is DataFrame functions. Tables are stored where they are read twice, so a lost executor costs one step.

Defined cases: a null column is hashed as ``-``, an empty text as ``0:``; null groups are a group of their own, before
all others and apart from the empty name; a null key comes first in its group and is never tampered with; rows that
repeat a key are leaves of their own, in the order of their digests, so that equal rows share digests but not proofs;
a long text is hashed whole; an empty table has no root and gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import join_counted, stored

FANOUT = 16
#: The columns that a leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """Each value as its byte count, a colon and itself; ``-`` if null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def lowered(column: str, value: Column) -> Column:
    """The tampering of the contract: A-Z of the text lower-cased."""
    return F.translate(value, CAPITALS, SMALL) if column == "text" else value


def leaves(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None, tamper: Callable[[str, Column], Column] = lowered) -> DataFrame:
    """(key, no_group, group, leaf, found): found is the digest of the row as it is now, where ``tampered`` holds of its change."""
    held = leaf([F.col(c) for c in columns])
    now = held if tampered is None else F.when(tampered, leaf([tamper(c, F.col(c)) for c in columns])).otherwise(held)
    name = F.col(group).cast("string")
    return docs.select(F.col(key).alias("key"), name.isNull().alias("no_group"), F.coalesce(name, F.lit("")).alias("group"), held.alias("leaf"), now.alias("found"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``index``, their place from 0 in this order; ties must be rows of which either may come first.

    Sorted by ranges, which the rows' place splits even where all else is equal. The counts of the partitions are the
    only rows that are summed in one task, and are as many as the partitions.
    """
    spread = F.monotonically_increasing_id()  # splits runs of equal rows
    ranged = rows.withColumn("__place", spread).repartitionByRange(*order, F.col("__place")).sortWithinPartitions(*order, "__place")
    placed = stored(ranged.drop("__place").withColumn("__at", F.monotonically_increasing_id()))
    part, inner = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__first"))
    return placed.join(F.broadcast(first), part == F.col("__part")).withColumn("index", F.col("__first") + inner).drop("__at", "__part", "__first")


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their group's number ``g``, its count ``n`` and their interval; and (g, no_group, group, n) of the groups, in order."""
    rows = stored(numbered(rows, [F.col("no_group").desc(), F.col("group"), F.col("key").asc_nulls_first(), F.col("leaf")]))
    groups = rows.groupBy("no_group", "group").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("first"))
    groups = stored(numbered(groups, [F.col("first")]).withColumnRenamed("index", "g"))
    lo = F.col("index") - F.col("first")
    out = join_counted(rows, groups, ["no_group", "group"], "n", rows.count())
    return stored(out.select("key", "g", "n", lo.alias("lo"), (lo + 1).alias("hi"), F.col("leaf").alias("digest"), "found")), groups


def nodes(bottom: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes (g, n, lo, hi, digest, kids) by level, from the leaves (level 0, ``bottom``, without kids) up."""
    most = bottom.agg(F.max("n")).first()[0] or 0
    levels, wide = [bottom], 1
    while wide < most:  # a group has several nodes of a level while its count is above their width
        below = levels[-1].filter(F.col("n") > wide)
        wide *= fanout
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        up = below.groupBy("g", "n", F.floor(F.col("lo") / wide).alias("bucket")).agg(kids.alias("kids"))
        text = F.array_join(F.transform("kids", lambda k: k["digest"]), "")
        levels.append(stored(up.select("g", "n", F.get("kids", F.lit(0))["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), digest(text).alias("digest"), "kids")))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(g, n, digest): the node that covers its whole group."""
    out = None
    for level in levels:
        top = level.filter((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).select("g", "n", "digest")
        out = top if out is None else out.unionByName(top)
    return out


def attached(levels: list[DataFrame], starts: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves with the columns of their group's row of ``starts`` (g, path, ...), and ``path`` down to the leaf.

    ``path`` lists (left, right), the concatenated digests of the siblings on either side, from the leaf up.
    """
    kept = [c for c in starts.columns if c not in ("g", "path")]
    above = None
    for level in range(len(levels) - 1, -1, -1):
        here, wide = levels[level], fanout ** (level + 1)
        top = here.filter((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).join(starts, "g")
        if above is None:
            above = top
            continue
        parents = above.select(F.col("g").alias("pg"), F.floor(F.col("lo") / wide).alias("bucket"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.col("kids").alias("pkids"), "path", *kept)
        inside = (F.col("g") == F.col("pg")) & (F.floor(F.col("lo") / wide) == F.col("bucket")) & (F.col("lo") >= F.col("plo")) & (F.col("hi") <= F.col("phi"))
        side = lambda test: F.array_join(F.transform(F.filter("pkids", test), lambda k: k["digest"]), "")
        own = F.struct(side(lambda k: k["hi"] <= F.col("lo")).alias("left"), side(lambda k: k["lo"] >= F.col("hi")).alias("right"))
        met = here.join(parents, inside).withColumn("path", F.concat(F.array(own), "path")).drop("pg", "bucket", "plo", "phi", "pkids")
        above = met.unionByName(top)
        if level:
            above = stored(above)
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda x, p: digest(p["left"], x, p["right"]))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Every node as (tree, no_group, group, level, lo, hi, digest): tree 0 for the groups' nodes, 1 for those above the subroots."""
    bottom, groups = ranked(leaves(docs, key, group, columns))
    own = nodes(bottom)
    above = nodes(_subroots(own))
    out = None
    for tree, levels in ((0, own), (1, above)):
        for level, rows in enumerate(levels):
            part = rows.select(F.lit(tree).alias("tree"), "g", F.lit(level).alias("level"), "lo", "hi", "digest")
            out = part if out is None else out.unionByName(part)
    name = groups.select("no_group", "group", F.col("g").alias("number"), "n")
    out = out.join(name, (F.col("tree") == 0) & (F.col("g") == F.col("number")), "left")
    return out.select("tree", "no_group", "group", "level", "lo", "hi", "digest")


def _subroots(own: list[DataFrame]) -> DataFrame:
    top = stored(tops(own).select("g", "digest"))
    return top.select(F.lit(0).cast("long").alias("g"), F.lit(top.count()).alias("n"), F.col("g").alias("lo"), (F.col("g") + 1).alias("hi"), "digest")


def proofs(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None) -> DataFrame:
    """(key, leaf, found, subroot, root, path) for every row; see ``leaves`` for found and ``attached`` for path."""
    bottom, _ = ranked(leaves(docs, key, group, columns, tampered))
    own = nodes(bottom)
    above = nodes(_subroots(own))
    root = tops(above).select("g", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("root"))
    starts = stored(attached(above, root).select(F.col("lo").alias("g"), F.col("digest").alias("subroot"), "root", "path"))
    out = attached(own, starts)
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "found", "subroot", "root", "path")


def verified(proofs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of rows of ``proofs``."""
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    out = proofs.select(key, "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), fold(F.col("found"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
