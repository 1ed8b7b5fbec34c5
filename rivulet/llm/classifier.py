"""Operator 4: quality classifier with supervised subword embeddings.

A text is the average of the vectors of its features: hashed words, hashed pairs of neighbouring words (by the exclusive
or of their hashes, so that all repetitions of a word share one vector), and hashed byte 3- and 4-grams. A softmax layer over two classes sits on top; vectors and layer are learned together by mini-batch stochastic gradient descent in
numpy. Since the layer is linear in the average, scoring needs one number per bucket: whole texts are scored in Spark
tasks from a broadcast table of 2**BITS floats.

Defined cases: a null or empty text has no features and is scored by the bias alone; null labels and null ids teach
nothing; several labels of one id count as the highest, and every row that repeats the id has it; without labels of both classes the score is the known class's rate (0.5 if
none); a long text is taken in runs; repeated rows each get a row; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_texts, gram_hash, gram_runs, join_counted, mixed, pieces, stored, window_sums, word_hashes

BITS = 14
GRAMS = (3, 4)
DIM = 8
#: Labelled texts that the model is fitted on at most (see ``bounded_texts``).
FIT_ROWS = 6_000


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float


def _word_features(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, each followed by that of the pair it ends (if any), and each text's offsets into them."""
    words, at = word_hashes(data, off)
    pairs = mixed(words[1:] ^ words[:-1] ^ np.uint64(0x9E3779B97F4A7C15))
    both = np.empty(2 * len(words), np.uint64)
    both[::2], both[3::2] = words, pairs
    inside = np.ones(len(both), bool)
    first = at[:-1][np.diff(at) > 0]
    inside[2 * first + 1] = False  # a text's first word ends no pair
    run = np.concatenate(([0], np.cumsum(inside)))
    return (both[inside] >> np.uint64(64 - BITS)).astype(np.int64), run[2 * at]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label, times = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        out = []
        for first, off, data in pieces(batch.column(1)):
            one = len(off) == 2  # a long text is a piece of its own
            grams = [] if one else [(n, gram_hash(data, n, BITS)) for n in GRAMS]
            words, word_off = _word_features(off, data)
            for i in range(len(off) - 1):
                own = (h for n in GRAMS for h in gram_runs(data, n, BITS)) if one else (h[off[i] : max(off[i], off[i + 1] - n + 1)] for n, h in grams)
                bag = np.bincount(words[word_off[i] : word_off[i + 1]], minlength=1 << BITS)
                for h in own:
                    bag += np.bincount(h.astype(np.int64), minlength=1 << BITS)
                at = np.flatnonzero(bag)
                share = (bag[at] / max(1, bag.sum())).astype(np.float32)
                out.append((label[first + i], times[first + i], at.astype(np.uint16).tobytes(), share.tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["label", "times", "at", "share"])


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 60.0, batch: int = 32, seed: int = 1) -> Model:
    """Mini-batch SGD over (label, buckets, shares); the rate falls linearly to zero."""
    y = np.array([b[0] for b in bags], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        p = float(y.mean()) if len(y) else 0.5
        p = min(max(p, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    steps = epochs * ((len(y) + batch - 1) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            x = np.zeros((len(rows), 1 << BITS), np.float32)
            for k, r in enumerate(rows):
                x[k, bags[r][1]] = bags[r][2]
            hidden = x @ vectors
            z = hidden @ layer + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            now = rate * (1 - step / steps)
            back = p @ layer.T
            layer -= np.float32(now / 60) * (hidden.T @ p)
            bias -= np.float32(now / 600) * p.sum(axis=0)
            used = np.unique(np.concatenate([bags[r][1] for r in rows]))
            vectors[used] -= np.float32(now) * (x[:, used].T @ back)
            step += 1
    out = layer[:, 1] - layer[:, 0]
    return Model((vectors @ out).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on at most ``fit_rows`` of the labelled texts, whatever the number of rows with one id."""
    own = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
    slim = stored(own.select("k", F.xxhash64("text").alias("h")))
    labelled = labels.filter(F.col(target).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(target).cast("int").alias("label"))
    per = stored(slim.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(labelled, "k"))
    rows = bounded_texts(join_counted(slim, per, ["k"], "n", slim.count()).select("label", "h"), own, "text", "label", fit_rows)
    got = rows.repartition(8).mapInArrow(_bags, "label int, times long, at binary, share binary").toArrow()
    bags = [(y, np.frombuffer(a, np.uint16), np.frombuffer(s, np.float32)) for y, m, a, s in zip(*(got[c].to_pylist() for c in ("label", "times", "at", "share")), strict=True) for _ in range(m)]
    bags.sort(key=lambda b: (b[0], b[1].tobytes(), b[2].tobytes()))  # the order of arrival must not matter
    return fit(bags)


def scores(model: Model, col: pa.Array) -> np.ndarray:
    out = np.zeros(len(col))
    for first, off, data in pieces(col):
        total, count = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
        for n in GRAMS:
            count += np.maximum(0, np.diff(off) - n + 1)
            if len(off) == 2:
                total += sum(model.weight[h].sum(dtype=np.float64) for h in gram_runs(data, n, BITS))
            else:
                total += window_sums(model.weight[gram_hash(data, n, BITS)], off, n)
        words, word_off = _word_features(off, data)
        run = np.concatenate(([0.0], np.cumsum(model.weight[words], dtype=np.float64)))
        total += run[word_off[1:]] - run[word_off[:-1]]
        count += np.diff(word_off)
        z = model.bias + np.where(count > 0, total / np.maximum(count, 1), 0)
        out[first : first + len(off) - 1] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score): the probability of class 1 for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(m, batch.column(1)), pa.float64())], [key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
