"""Operator 1 (native): quality rules with cross-document line frequency.

``base_rules`` measures each whole text in one row. ``line_rule`` hashes normalised lines (blanks collapsed, trimmed,
lower case), counts the distinct documents that hold a line per host, removes lines in more than ``max_documents``
documents of their host, and rejects documents of which too few words are left. With ``percent`` the limit follows the
size of the host: a line goes if more than ``percent`` per cent of the host's distinct documents hold it, and more than
``min_documents``; ``max_documents`` is not used then.

A line that a third of all documents hold is met in the tasks that read its rows (``join_counted``).

Defined cases: null text is empty: no words, fails the base rules; null hosts are one host of their own, apart from the
empty name; rows repeated with one key count as one document in line counts, and each gets a row; texts without lines
above the limit lose nothing; rows with a null key count in line counts as one document and lose nothing, as in the SQL;
a line at the limit stays; an empty table gives an empty result; further columns are ignored by the rules, whatever their
names, and carried along by ``without_boilerplate``, but those named remaining_text or n_left_words are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import SPACE, join_counted, stored, unused, without

#: A line in more documents of one host than this is boilerplate.
MAX_DOCUMENTS = 20
#: The same as a share of the host's distinct documents, and the least number of documents that it takes.
PERCENT, MIN_DOCUMENTS = 4, 4
#: A document is depleted if less than this share of its words, or fewer words than MIN_WORDS, are left.
MIN_SHARE = 0.2
MIN_WORDS = 20
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def base_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) per row."""
    body = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(F.col(key), *also, body.alias("__t"))
    worded = F.filter(F.split("__t", "\n", -1), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    one = one.select(key, *also, "__t", worded.alias("__lines"), F.transform(words_of(F.col("__t")), lambda w: F.xxhash64(w)).alias("__w"))
    starts = F.when(F.size("__w") >= WINDOW, F.sequence(F.lit(0), F.size("__w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    one = one.select(
        key,
        *also,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(WINDOW)])).alias("__h"),
    )
    # only texts with a repeated window are sorted
    pairs = F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    one = one.withColumn("__p", pairs).drop("__h")
    same = lambda i: F.get("__p", i)["h"].eqNullSafe(F.get("__p", i + 1)["h"])
    twice = F.filter(F.col("__p"), lambda x, i: F.when(i > 0, same(i - 1)).otherwise(F.lit(False)) | same(i))
    one = one.withColumn("__s", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__p")
    covered = F.aggregate(F.transform("__s", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__s", i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    one = one.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__s")
    return one.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _host(host: str) -> list[Column]:
    """A host as columns that equal themselves: null is a host of its own."""
    return [F.col(host).isNull().alias("no_host"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")]


def limited(held: DataFrame, docs: DataFrame, max_documents: int, percent: int | None, min_documents: int, key: str, host: str) -> DataFrame:
    """(no_host, host, h, n): the lines of ``held`` above the limit of their host, and their documents."""
    counts = held.groupBy("no_host", "host", "h").agg(F.count(F.lit(1)).alias("n"))
    if percent is None:
        return counts.filter(F.col("n") > max_documents)
    sizes = docs.select(*_host(host), F.col(key).alias("k")).distinct().groupBy("no_host", "host").agg(F.count(F.lit(1)).alias("size"))
    often = counts.filter(F.col("n") > min_documents).join(sizes, ["no_host", "host"])
    return often.filter(100 * F.col("n") > percent * F.col("size")).drop("size")


def normal(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, SPACE + "+", " ")))


def without_boilerplate(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, text: str = "text", key: str = "doc_id", host: str = "source", percent: int | None = None, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with remaining_text, the text without the lines above the limit, and n_left_words, null if none is."""
    docs = without(docs, "remaining_text", "n_left_words")
    body = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.col(key).alias("k"), *_host(host), F.explode(F.split(body, "\n", -1)).alias("line"))
    # one row for each line of a document: stored, since counts and removal both read it
    lines = lines.select("k", "no_host", "host", normal(F.col("line")).alias("line")).filter("line != ''")
    held = stored(lines.select("k", "no_host", "host", F.xxhash64("line").alias("h")).distinct())
    common = stored(limited(held, docs, max_documents, percent, min_documents, key, host))
    id_, nameless, name, gone = (unused(docs, c) for c in ("id", "nameless", "name", "gone"))
    lost = join_counted(held, common, ["no_host", "host", "h"], "n", held.count())
    lost = lost.groupBy("k", "no_host", "host").agg(F.collect_set("h")).toDF(id_, nameless, name, gone)
    own = _host(host)
    # rows without a key lose nothing: they stay where they are
    joined = docs.filter(F.col(key).isNotNull()).join(lost, (F.col(key) == F.col(id_)) & (own[0] == F.col(nameless)) & (own[1] == F.col(name)), "left")
    out = joined.unionByName(docs.filter(F.col(key).isNull()), allowMissingColumns=True)
    stays = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(gone, F.xxhash64(normal(x))))
    out = out.withColumn("remaining_text", F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(stays, "\n")))
    left = F.when(F.col(gone).isNotNull(), F.size(words_of(F.col("remaining_text"))))
    return out.withColumn("n_left_words", left.cast("long")).drop(id_, nameless, name, gone)


def line_rule(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, text: str = "text", key: str = "doc_id", host: str = "source", percent: int | None = None, min_documents: int = MIN_DOCUMENTS, also: tuple[str, ...] = ()) -> DataFrame:
    """``base_rules`` with n_removed_words and kept, from what is left: the base rules and the depletion rule both passed.

    ``also``: further columns of ``docs``, or remaining_text.
    """
    rows = without_boilerplate(docs, max_documents, text, key, host, percent, min_documents)
    base = base_rules(rows, text, key, ("n_left_words", *also))
    base = stored(base)  # rows of numbers, read twice
    # words on lines that are not blank are all words; rows with one key are one document, which the few of several rows meet
    rest = F.coalesce("n_left_words", "n_words")
    per = base.filter(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.sum(rest).alias("__rest"), F.sum("n_words").alias("__total"), F.count(F.lit(1)).alias("__rows")).filter("__rows > 1")
    base = join_counted(base, stored(per), [key], "__rows", base.count(), "left").drop("__rows")
    base = base.withColumns({"__rest": F.coalesce("__rest", rest), "__total": F.coalesce("__total", "n_words")})
    gone = F.when(F.col(key).isNull(), 0).otherwise(F.col("__total") - F.col("__rest"))
    depleted = (gone > 0) & ((F.col("__rest") < MIN_WORDS) | (F.col("__rest") < MIN_SHARE * F.col("__total")))
    out = base.withColumn("n_removed_words", gone).withColumn("kept", ~F.col("base_failed") & ~depleted)
    return out.drop("n_left_words", "__rest", "__total")
