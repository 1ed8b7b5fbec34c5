"""Operator 5: line dedup over overlapping three-line windows.

Every run of ``width`` consecutive lines is hashed; a window whose hash occurs earlier in the corpus, in the order of
(key, line number), is a later occurrence. The lines that later windows cover are merged and removed; the first
occurrence stays. Lines are the ``\\n``-split parts of the whole text, compared after trimming blanks at both ends.

A window that a third of all documents hold is met in the tasks that read its rows (``join_counted``).

Defined cases: null or empty text and texts of fewer than ``width`` lines have no window and stay as they are; windows
of nothing but blank lines count for nothing; rows repeated with one key count as one document, and a null key comes
before all others and loses nothing; of equal windows the first by key and line stays; other columns are carried along,
but those named n_lines, n_removed or n_spans are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import join_counted, stored, unused, without

BLANK = " \t\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def later_windows(docs: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, starts): the sorted first lines (from 0) of a document's windows that occur earlier in the corpus."""
    lines = docs.select(F.col(key).alias("k"), F.transform(_lines(F.col(text)), lambda x: F.xxhash64(F.btrim(x, F.lit(BLANK)))).alias("h"))
    blank = F.xxhash64(F.lit(""))
    lines = lines.filter(F.size("h") >= width)
    starts = F.sequence(F.lit(0), F.size("h") - width)
    one = F.transform(starts, lambda i: F.when(F.exists(F.slice(F.col("h"), i + 1, width), lambda x: x != blank), F.xxhash64(*[F.get("h", i + j) for j in range(width)])))
    # a table: the hashes are read twice, the texts once
    windows = stored(lines.select("k", F.posexplode(one).alias("at", "w")).filter("w is not null"))
    first = windows.groupBy("w").agg(F.min(F.struct("k", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = join_counted(windows, first, ["w"], "n", windows.count()).filter(F.struct("k", "at") > F.col("first"))
    return later.groupBy("k").agg(F.sort_array(F.collect_set("at")).alias("starts")).withColumnRenamed("k", key)


def dedup(docs: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id", counts: bool = True) -> DataFrame:
    """``docs`` with the text's kept lines, and with ``counts`` n_lines, n_removed and n_spans (merged runs of lines)."""
    docs = without(docs, "n_lines", "n_removed", "n_spans") if counts else docs
    id_, starts, lines, runs, ends = (unused(docs, c) for c in ("id", "starts", "lines", "runs", "ends"))
    found = later_windows(docs, width, text, key).toDF(id_, starts)
    at = lambda i: F.get(starts, i)
    # a null key loses nothing: its rows stay where they are
    met = docs.filter(F.col(key).isNotNull()).join(found, F.col(key) == F.col(id_), "left")
    joined = met.unionByName(docs.filter(F.col(key).isNull()), allowMissingColumns=True).withColumns({starts: F.coalesce(F.col(starts), F.array().cast("array<int>")), lines: _lines(F.col(text))})
    gap = lambda i: at(i) - at(i - 1)
    places = F.when(F.size(starts) > 0, F.sequence(F.lit(0), F.size(starts) - 1)).otherwise(F.array().cast("array<int>"))
    # merged runs: a window whose predecessor starts less than width lines (or just width) before it lengthens that run
    first = F.filter(places, lambda i: (i == 0) | (gap(i) > width))
    last = F.filter(F.transform(places, lambda i: F.when((i == F.size(starts) - 1) | (gap(i + 1) > width), at(i) + width)), lambda x: x.isNotNull())
    joined = joined.withColumns({runs: F.transform(first, at), ends: last})
    removed = F.aggregate(F.zip_with(runs, ends, lambda a, b: b - a), F.lit(0), lambda a, x: a + x)
    # the lines between runs: from the end of one to the start of the next
    left = F.transform(F.concat(F.array(F.lit(0)), F.col(ends)), lambda a, i: F.slice(lines, a + 1, F.coalesce(F.get(runs, i), F.size(lines)) - a))
    kept = F.when(F.size(runs) == 0, F.col(text)).otherwise(F.array_join(F.flatten(left), "\n"))
    told = {"n_lines": F.when(F.col(text).isNull() | (F.col(text) == ""), 0).otherwise(F.size(lines)), "n_removed": removed, "n_spans": F.size(runs)}
    out = joined.withColumns({**(told if counts else {}), text: kept})
    return out.drop(id_, starts, lines, runs, ends)
