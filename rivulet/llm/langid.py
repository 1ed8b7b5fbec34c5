"""Operator 7: language ID by multinomial naive Bayes over hashed character n-grams.

``train`` counts the hashed byte n-grams of labelled texts in Spark tasks and turns them into a sparse matrix of log
probabilities (languages x 2**BITS): the buckets that a language was seen in, and one value for all others. Its size is
bounded by the fitted texts, not by the corpus. ``predict`` broadcasts it and scores batches of whole texts in numpy, in
dense blocks of ``BLOCK`` languages, so that every language of the fitted texts is learned, however many there are.

Defined cases: null or letterless text is ``und`` with score 0; rows with null language or text teach nothing; ids, null
and repeated ones too, play no part in what is learned; without any labelled text, or on an empty table, every row is
``und``; a long text is counted and scored in runs; ties go to the first language by name; repeated rows each get a row;
other columns are carried along by ``predict``, but those with the names of its own columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import LOWER, bounded_texts, gram_hash, gram_runs, pieces, stored, unused, window_sums, without

BITS = 16
ORDERS = (2, 3, 4)
#: Labelled texts that the model is fitted on at most (see ``bounded_texts``).
FIT_ROWS = 20_000
#: Languages that are scored at a time.
BLOCK = 16


@dataclass(frozen=True)
class Model:
    """Of language k: prior[k], the log probability of buckets it was not seen in, unseen[k], and of those it was, logp[first[k] : first[k + 1]], by bucket."""

    langs: list[str]
    prior: np.ndarray
    unseen: np.ndarray
    first: np.ndarray
    bucket: np.ndarray
    logp: np.ndarray

    def parts(self) -> tuple:
        """What is broadcast: tasks need not have this class."""
        return self.langs, self.prior, self.unseen, self.first, self.bucket, self.logp

    def dense(self, a: int, b: int) -> np.ndarray:
        """Log probabilities of languages a to b in all buckets."""
        out = np.repeat(self.unseen[a:b, None], 1 << BITS, axis=1)
        for k in range(a, b):
            at = slice(self.first[k], self.first[k + 1])
            out[k - a, self.bucket[at]] = self.logp[at]
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, bucket, n) of runs of (language, text, times)."""
    for batch in batches:
        langs, times = batch.column(0), batch.column(2).to_numpy()
        for first, off, data in pieces(batch.column(1)):
            names = langs.slice(first, len(off) - 1).dictionary_encode()
            code = names.indices.to_numpy().astype(np.int64) << BITS
            counts: list[tuple[np.ndarray, np.ndarray]] = []
            for n in ORDERS:
                if len(off) == 2:
                    for h in gram_runs(LOWER[data], n, BITS):
                        keys, many = np.unique(code[0] + h.astype(np.int64), return_counts=True)
                        counts.append((keys, many * times[first]))
                else:
                    h = gram_hash(LOWER[data], n, BITS)
                    at = np.repeat(off[:-1], np.maximum(0, np.diff(off) - n + 1))
                    at += np.arange(len(at)) - np.searchsorted(at, at)  # grams within one text
                    owner = np.repeat(np.arange(len(off) - 1), np.maximum(0, np.diff(off) - n + 1))
                    keys, where = np.unique(code[owner] + h[at].astype(np.int64), return_inverse=True)
                    many = np.zeros(len(keys), np.int64)
                    np.add.at(many, where, times[first + owner])
                    counts.append((keys, many))
            if not counts:  # an empty text
                continue
            keys, n = (np.concatenate(x) for x in zip(*counts, strict=True))
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(keys >> BITS)), pa.array((keys & ((1 << BITS) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "bucket", "n"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, alpha: float = 0.1) -> Model:
    """Fits on at most ``fit_rows`` rows with a text and a language."""
    own = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = stored(bounded_texts(own.select("lang", F.xxhash64("text").alias("h")), own, "text", "lang", fit_rows)).repartition(16)
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum("times").alias("n")).collect()}  # fit_rows at most
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # as many rows as the fitted texts have grams, at most
    langs = sorted(texts)
    share = np.array([texts[x] for x in langs], float)
    names = pa.array(langs, pa.string())
    number = pc.index_in(got["lang"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    bucket, n = got["bucket"].to_numpy().astype(np.int64), got["n"].to_numpy()
    order = np.lexsort((bucket, number))
    number, bucket, n = number[order], bucket[order], n[order]
    total = np.bincount(number, n, len(langs)) + alpha * (1 << BITS)
    logp = np.log((n + alpha) / total[number]).astype(np.float32)
    return Model(langs, np.log(share / share.sum()), np.log(alpha / total).astype(np.float32), np.searchsorted(number, np.arange(len(langs) + 1)), bucket.astype(np.int32), logp)


def log_odds(prior: np.ndarray, logp: np.ndarray, col: pa.Array) -> np.ndarray:
    """(rows x languages) log joint probabilities of whole texts."""
    out = np.zeros((len(col), len(prior)))
    for first, off, data in pieces(col):
        data = LOWER[data]
        part = out[first : first + len(off) - 1]
        part += prior
        for n in ORDERS:
            if len(off) == 2:
                for h in gram_runs(data, n, BITS):
                    part[0] += [row[h].sum(dtype=np.float64) for row in logp]
                continue
            h = gram_hash(data, n, BITS)
            for k in range(len(prior)):
                part[:, k] += window_sums(logp[k][h], off, n)
    return out


def judged(model: Model, blocks: list[tuple[int, np.ndarray]] | None, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest language of each text, and its posterior probability. ``blocks``: dense blocks that are kept, if few."""
    best, most, total = np.zeros(len(col), np.int64), np.full(len(col), -np.inf), np.zeros(len(col))
    for a, logp in blocks or ((a, model.dense(a, min(a + BLOCK, len(model.langs)))) for a in range(0, len(model.langs), BLOCK)):
        z = log_odds(model.prior[a : a + len(logp)], logp, col)
        top = np.maximum(most, z.max(axis=1))
        best = np.where(top > most, a + z.argmax(axis=1), best)  # ties stay with the first by name
        total = total * np.exp(most - top) + np.exp(z - top[:, None]).sum(axis=1)
        most = top
    return best, 1 / total


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with ``pred`` and ``score``, the posterior probability of that language."""
    docs = without(docs, pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    schema = T.StructType([f for f in docs.schema.fields] + [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    at = docs.columns.index(text)
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        names = np.array(m.langs, dtype=object)
        few = [(0, m.dense(0, len(names)))] if 0 < len(names) <= BLOCK else None
        for batch in batches:
            *columns, has = batch.columns
            lang, p = np.full(len(batch), "und", dtype=object), np.zeros(len(batch))
            if m.langs and len(batch):
                best, sure = judged(m, few, columns[at])
                has = has.to_numpy(zero_copy_only=False).astype(bool)
                lang, p = np.where(has, names[best], "und"), np.where(has, sure, 0.0)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(p, pa.float64())], names=[f.name for f in schema.fields])

    return docs.select("*", lettered.alias(unused(docs, "lettered"))).mapInArrow(run, schema)


def accepted(min_score: float = 0.5, pred: str = "lang_pred", score: str = "score") -> Column:
    """The filter's verdict: a known language, and more likely than all the others together."""
    return (F.col(pred) != "und") & (F.col(score) >= min_score)
