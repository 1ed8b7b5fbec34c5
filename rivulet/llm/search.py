"""Operator 12: ranked lexical search by an Aho-Corasick scan of the documents.

The query set (items) is small and stated; its distinct terms, each between two boundaries, become one automaton, which is
broadcast. Tasks read whole texts with it and count term frequencies straight from the bytes: no index of the documents
is built and no row of a document is shuffled. A first scan sums what the weights need (documents, terms, documents of
each term); a second one scores each document against the items that its terms map to, and hands on a task's best for
each item. Items come in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_BYTES`` of text, each with an automaton
of its own, so what is broadcast has a bound whatever the number of items.

Bytes: A-Z become a-z, all other ASCII but letters and digits becomes a blank, and the rest stays, so terms are what stands
between blanks in UTF-8 as in code points. Scores are sums in 64-bit integers.

Defined cases: a null text, or one without terms, has no term and is no hit; a null item text, or one without terms, has
no hits; without any term in the documents there are none at all; every row of documents is a document, repeated keys too,
and every row of items an item; equal scores go by key, null keys last; a long text is scanned in runs that end between
terms; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import PIECE_BYTES, pieces, stored

#: Items of one automaton at most, and bytes of their texts, about.
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 8 << 20
#: The bytes of texts as the automaton reads them.
READ = np.full(256, 32, np.uint8)
READ[48:58], READ[97:123], READ[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
READ[65:91] = READ[97:123]
READ_TABLE = READ.tobytes()
# Fixed value: what is no term, between terms.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_KEY = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Vocabulary:
    """Terms of one block of items: automaton, and the items (from 0) and counts that each term maps to, in runs."""

    automaton: ahocorasick.Automaton
    size: int
    items: int
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray

    def parts(self) -> tuple:
        """What is broadcast: tasks need not have this class."""
        return self.automaton, self.size, self.items, self.first, self.item, self.times


def terms_of(text: Column) -> Column:
    """All terms of a text, in order."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, APART), lambda t: t != "")


def vocabulary(terms: pa.Table) -> Vocabulary:
    """Of rows (item, term, times)."""
    coded = terms["term"].combine_chunks().dictionary_encode() if len(terms) else pa.array([], pa.string()).dictionary_encode()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(coded.dictionary.to_pylist()):
        automaton.add_word(f" {term.encode().decode('latin-1')} ", i)
    automaton.make_automaton()
    code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    order = np.argsort(code, kind="stable")
    item, times = terms["item"].to_numpy().astype(np.int64), terms["times"].to_numpy().astype(np.int64)
    return Vocabulary(automaton, size, int(item.max()) + 1 if len(item) else 0, np.searchsorted(code[order], np.arange(size + 1)), item[order], times[order])


def _runs(read: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in runs that end before a blank."""
    at = 0
    while len(read) - at > PIECE_BYTES:
        end, step = at + PIECE_BYTES, 1 << 12
        while end < len(read) and not (read[end : end + step] == 32).any():
            end += step
        end = min(len(read), end + int((read[end : end + step] == 32).argmax()))
        yield read[at:end]
        at = end
    yield read[at:]


def _hits(automaton: ahocorasick.Automaton, read: np.ndarray) -> np.ndarray:
    """(end, term) of every term of the vocabulary, in order."""
    if not len(automaton):
        return np.zeros((0, 2), np.int64)
    text = " " + read.tobytes().decode("latin-1") + " "
    return np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)


def counted(v: Vocabulary, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: first row, terms of each text, and (text, term, tf) of the vocabulary's terms in them."""
    for first, off, data in pieces(col):
        n = len(off) - 1
        if n == 1 and len(data) > 2 * PIECE_BYTES:
            total, tf = 0, np.zeros(v.size, np.int64)
            for run in _runs(READ[data]):
                total += _starts(run, np.array([0])).size
                tf += np.bincount(_hits(v.automaton, run)[:, 1], minlength=v.size)
            term = np.flatnonzero(tf)
            yield first, np.array([total]), np.zeros(len(term), np.int64), term, tf[term]
            continue
        # a blank between neighbours, so that no term reaches over two texts
        owner = np.repeat(np.arange(n), np.diff(off))
        read = np.full(len(data) + n, 32, np.uint8)
        read[np.arange(len(data)) + owner] = READ[data]
        off = off + np.arange(n + 1)
        terms = np.bincount(np.searchsorted(off, _starts(read, off[:-1]), side="right") - 1, minlength=n)
        hits = _hits(v.automaton, read)
        text = np.searchsorted(off, hits[:, 0] - 2, side="right") - 1  # the hit ends one blank behind the term, and one stands before all
        both, tf = np.unique(text * max(1, v.size) + hits[:, 1], return_counts=True)
        yield first, terms, both // max(1, v.size), both % max(1, v.size), tf


def _starts(read: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where terms start."""
    held = read != 32
    before = np.zeros(len(read), bool)
    before[1:] = held[:-1]
    before[off[off < len(read)]] = False
    return np.flatnonzero(held & ~before)


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def totals(docs: DataFrame, v: Vocabulary, text: str = "text") -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents of each term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(v.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, documents, length = Vocabulary(*shared.value), 0, 0
        df = np.zeros(v.size, np.int64)
        for batch in batches:
            for _, terms, _, term, _ in counted(v, batch.column(0)):
                documents, length = documents + int((terms > 0).sum()), length + int(terms.sum())
                df += np.bincount(term, minlength=v.size)
        told = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *told]), pa.array([documents, length, *df[told]])], ["what", "n"])

    got = docs.select(text).mapInArrow(run, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of a block
    what, n = got["what"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(v.size, np.int64)
    df[what[what >= 0]] = n[what >= 0]
    return int(n[what == -1].sum()), int(n[what == -2].sum()), df


class Best:
    """The ``k`` best (score, key) of each item, equal scores by ascending key."""

    def __init__(self, k: int):
        self.k = k
        self.item, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.zeros(0, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, key: np.ndarray, items: int) -> None:
        if not len(self.least):
            self.least = np.ones(items, np.int64)
        good = score >= self.least[item]
        if not good.any():
            return
        item, score, key = (np.concatenate(x) for x in ((self.item, item[good]), (self.score, score[good]), (self.key, key[good])))
        order = np.lexsort((key, -score, item))
        item, score, key = item[order], score[order], key[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.k
        full = place == self.k - 1
        self.least[item[full]] = score[full]
        self.item, self.score, self.key = item[kept], score[kept], key[kept]


def item_scores(v: Vocabulary, weight: np.ndarray, documents: int, length: int, terms: np.ndarray, text: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """(texts x items) scores."""
    out = np.zeros(len(terms) * v.items, np.int64)
    m = np.array([100 - 75 + 75 * n * documents // length for n in terms.tolist()], np.int64)
    part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[text]))
    many = v.first[term + 1] - v.first[term]
    at = np.repeat(v.first[term] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    np.add.at(out, np.repeat(text, many) * v.items + v.item[at], np.repeat(part, many) * v.times[at])
    return out.reshape(len(terms), v.items)


def _block(docs: DataFrame, v: Vocabulary, k: int, text: str, key: str) -> DataFrame:
    """(number, doc, score): each task's best for each item of a block."""
    documents, length, df = totals(docs, v, text)
    shared = docs.sparkSession.sparkContext.broadcast((v.parts(), weights(documents, df)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        v, best = Vocabulary(*own), Best(k)
        for batch in batches:
            keys = batch.column(0).cast(pa.int64()).fill_null(NO_KEY).to_numpy()
            for first, terms, doc, term, tf in counted(v, batch.column(1)):
                if not len(term):
                    continue
                # some texts at a time, so that their scores fit in memory
                step = max(1, (1 << 20) // max(1, v.items))
                for a in range(0, len(terms), step):
                    own = slice(*np.searchsorted(doc, [a, a + step]))
                    score = item_scores(v, weight, documents, length, terms[a : a + step], doc[own] - a, term[own], tf[own])
                    row, item = np.nonzero(score)
                    best.add(item, score[row, item], keys[first + a + row], v.items)
        found = pa.array(best.key, mask=best.key == NO_KEY)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), found, pa.array(best.score)], ["number", "doc", "score"])

    return docs.select(key, text).mapInArrow(run, "number long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, key, score): the ``k`` best documents of each item with a score above 0. Keys of documents are integers."""
    rows = stored(items.select(F.col(item).alias("item"), F.col(item_text).alias("t")).withColumn("row", F.monotonically_increasing_id()))
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, math.ceil(count / block_items), math.ceil(size / block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    # numbers inside a block: its rows are about BLOCK_ITEMS
    rows = stored(rows.withColumn("number", F.row_number().over(Window.partitionBy("block").orderBy("row")).cast("long") - 1))
    per = stored(rows.select("block", F.col("number").alias("item"), F.explode(terms_of(F.col("t"))).alias("term")).groupBy("block", "item", "term").agg(F.count(F.lit(1)).alias("times")))
    out = None
    for b in range(blocks):
        v = vocabulary(per.filter(F.col("block") == b).select("item", "term", "times").toArrow())
        part = _block(docs, v, k, text, key).withColumn("block", F.lit(b).cast("long"))
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("block", "number").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    best = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = rows.select("block", "number", "item")
    return best.join(names, ["block", "number"]).select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")
