"""Operator 10: bounded-space online best-fit packing of tokenised texts into fixed-length sequences.

``cut`` tokenises whole texts and cuts those longer than a sequence into full-length pieces, the first of which may be
shorter. ``pack`` places the pieces: full ones fill a sequence alone; the others are dealt by a hash into groups of
bounded size, and each group is packed online by best fit into at most ``open_bins`` open bins. Pieces arrive in rounds of
``ROUND``, the long ones of a round first, which leaves a tenth of the loss of a random order. The bins are kept in a
bitset keyed by free space (bit f set: some open bin has f tokens free), so the best fit and the fullest bin are the
lowest set bits of it; when one bin too many is open, the fullest closes.

Defined cases: a null text is empty and gives one piece holding the end id alone; a long text is encoded in windows of
``WINDOW`` characters, cut where the ids can't change; repeated rows are packed as rows of their own, null keys too, and are dealt like others; an
empty table gives no pieces; ties between bins of equal free space go to the one that reached it last; ``cut`` ignores
other columns, ``pack`` carries them along, but replaces columns named sequence_id or offset.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import stored, unused

#: Short pieces that one task packs, on average.
GROUP_PIECES = 50_000
#: Pieces that a task orders by length at a time.
ROUND = 4096
#: Characters of a long text that are encoded at a time.
WINDOW = 1 << 20
#: A place where every split falls, whatever stands around it: before a lone space or line end between other characters.
APART = re.compile(r"(?<=\S)[ \n](?=\S)")
#: White space so long that a splitting pattern that recurses may not manage it.
BLANK = re.compile(r"\s{1000}")
# Fixed value: the split pattern that byte-level tokenizer files of this kind leave unsaid.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it can be printed, else in order from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class TextEncoder:
    """Ids of whole texts by the tokenizer of a file of the ``tokenizers`` library, without its extra special tokens.

    A byte-level BPE file whose merges are in the order of their ids is its own table of ranks, and ``tiktoken`` gives the
    same ids from such a table in a quarter of the time. Texts with special strings or very long white space, and files of
    any other kind, are left to the library itself.
    """

    def __init__(self, path: str):
        self.path = path
        self.plain = None
        self.ranked = None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [x["content"] for x in told.get("added_tokens") or []]
        model, split = told["model"], told.get("pre_tokenizer") or {}
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model.get("merges", [])]
        alike = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        if model.get("type") == "BPE" and alike and not told.get("normalizer") and not any(map(model.get, options)) and all(a < b for a, b in pairwise(merged)):
            import tiktoken

            byte = _byte_of()
            ranks = {bytes(map(byte.__getitem__, token)): i for token, i in model["vocab"].items() if token not in self.special}
            self.ranked = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> list[int]:
        if self.plain is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the text."""
        if self.ranked is None:
            return np.array(self._library(text), "<u4").tobytes()
        out, at = [], 0
        while at < len(text) or not out:
            cut = APART.search(text, at + WINDOW) if len(text) - at > WINDOW else None
            end = cut.start() if cut else len(text)
            part = text if end - at == len(text) else text[at:end]
            rare = any(x in part for x in self.special) or BLANK.search(part)
            out.append(np.array(self._library(part) if rare else self.ranked.encode_ordinary(part), "<u4").tobytes())
            at = end
        return b"".join(out)


def cut(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids): the pieces of every text; ids are little-endian unsigned 32-bit."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(tokenizer_path)
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [kind, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [key, "piece", "start", "length", "ids"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(t.as_py() or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at) % length or length
                    rows.append((k, piece, at, size, ids[4 * at : 4 * (at + size)]))
                    at, piece, held = at + size, piece + 1, held + 4 * size
                    if held > 8 << 20:
                        yield batch_of()
                        rows, held = [], 0
        yield batch_of()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids binary")


class Bins:
    """Open bins of one task: free space by bitset."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.count = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.opened = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        b = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return b

    def place(self, size: int) -> tuple[int, int]:
        """(number of the bin, offset in it)."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            b, free = self.opened, self.length
            self.opened += 1
        rest = free - size
        if rest:
            self.by_free[rest].append(b)
            self.bits |= 1 << rest
            self.count += 1
            if self.count > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return b, self.length - free


def pack(pieces: DataFrame, length: int = 1024, open_bins: int = 4096, key: str = "doc_id", group_pieces: int = GROUP_PIECES, seed: int = 1) -> DataFrame:
    """``pieces`` (with piece and length) plus sequence_id and offset; every other column is carried along."""
    pieces = pieces.drop("sequence_id", "offset")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    row = unused(pieces, "row")
    # counted and read twice: tokenising once; the row's number keeps pieces of one key, or of none, apart
    held = stored(pieces.withColumn(row, F.monotonically_increasing_id()))
    short, pieces = held.filter(F.col("length") < length), held.drop(row)
    groups = max(1, math.ceil(short.count() / group_pieces))
    order = F.xxhash64(F.lit(seed), F.col(key), F.col("piece"), F.col(row))
    dealt = short.repartition(groups, order).sortWithinPartitions(order, key, "piece").drop(row)
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # odd numbers are for full pieces
        base = TaskContext.get().partitionId() << 32
        bins = Bins(length, open_bins)
        for batch in (whole.slice(i, ROUND) for whole in batches for i in range(0, len(whole), ROUND)):
            batch = batch.take(pa.array(np.argsort(-batch.column(at).to_numpy(), kind="stable")))
            put = [bins.place(n) for n in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([2 * (base + b) for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())], [f.name for f in schema.fields])

    full = pieces.filter(F.col("length") >= length).withColumns({"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")})
    return dealt.mapInArrow(run, schema).unionByName(full)
