"""Operator 6: removal of byte strings that start earlier in the corpus, bucket by bucket over a covered suffix sample.

A full suffix array needs a shuffled row for each byte, several times the input. So only a cover of the suffixes is
sorted: of the ``LENGTH - GRAM + 1`` places in each ``LENGTH``-byte string, the one whose ``GRAM``-byte hash is least (the
leftmost of equals) is its cover place. Equal strings have the same cover place relative to their start, so all suffixes
that can tie over ``LENGTH`` bytes meet in the bucket of their cover gram; unlike places chosen by position modulo a
period, one place in about sixteen suffices. The strings with one cover place are consecutive: their union is its context.

1. Documents send (gram, context hash, document, number of the place) to suffix buckets; a task first drops what
   it holds twice. Each bucket is sorted by gram and context, one bucket at a time. A context that a smaller document
   also has is removed whole. Long ties, that is equal grams with different contexts, are left to the second step.
2. For those alone, documents send the contexts' bytes to the same buckets. Every string in them is ranked by its hash,
   and those of which a smaller document holds the same are marked. A gram with more than ``HOT_CONTEXTS`` contexts does
   not go to one bucket: its strings are ranked where the text is, a task marks those that a smaller document of its own
   has, and the rest go to the buckets of their own ranks.
3. Documents collect the marks and cut the covered bytes.

Grams that a sample of the documents shows in many contexts skip the first step's buckets: their strings are ranked and
dealt as those of step 2. Which grams those are changes where strings meet, not what is found.

All three run over packed arrays; texts are shuffled once, by id and a hash of the text, and both later steps read that. So
a place is known by the id, which tells earlier documents from later ones, and by a number whose upper half is that hash:
rows with one id, or with none, spread over the groups and keep their places apart. A long text is hashed in runs of ``HASHED_BYTES``, and the number of tasks follows the number of buckets.

Defined cases: null text is empty; texts under ``LENGTH`` bytes keep everything; null ids count as the largest id; rows
that repeat an id are one document to each other, whatever their texts: none of them removes anything from another; of equal strings those in the document of the
least id stay; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import mixed, pieces, stored

LENGTH, GRAM = 50, 20
#: Bytes of text that a task packs at a time, that a suffix bucket covers, and that a group of documents holds.
FLUSH_BYTES, BUCKET_BYTES, GROUP_BYTES = 8 << 20, 4 << 20, 4 << 20
#: Bytes of text that are hashed at a time: some twenty arrays of so many 64-bit numbers.
HASHED_BYTES = 1 << 18
#: Long ties of one gram beyond which its strings spread over the buckets, and buckets of strings for each of suffixes:
#: a bucket's text can hold a string for each byte.
HOT_CONTEXTS, SPREAD = 4096, 4
#: Documents, of which one in ``SAMPLED`` is looked at, that make a gram frequent by its contexts there; such grams at most.
SAMPLED, FREQUENT_CONTEXTS, FREQUENT_GRAMS = 64, 512, 4096
#: Buckets, and groups of documents, of one task.
TASK_BUCKETS, TASK_GROUPS = 256, 64
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_DIGIT = np.random.default_rng(6).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        m = max(n, 2 * HASHED_BYTES)
        for name, base in (("up", _BASE), ("down", _BACK)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Hashes of any ranges of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_DIGIT[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def covers(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, context hash, first and last string start) of each cover place, in order.

    A long text is taken in runs of strings; a context that two of them share is two contexts, in every step alike.
    """
    if len(off) == 2 and len(data) > 2 * HASHED_BYTES:
        parts = []
        for a in range(0, len(data) - length + 1, HASHED_BYTES):
            part = data[a : a + HASHED_BYTES + length - 1]
            text, g, c, lo, hi = _covers(part, np.array([0, len(part)]), length, gram)
            parts.append((text, g, c, lo + a, hi + a))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _covers(data, off, length, gram)


def _covers(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if len(data) < length:
        return none
    roll = Rolling(data)
    at = np.arange(len(data) - gram + 1)
    hashes = mixed(roll.of(at, at + gram))
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span, wide = length - gram + 1, 1
    while 2 * wide <= span:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < span:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    counts = np.maximum(0, np.diff(off) - length + 1)
    first = np.repeat(off[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    starts = np.arange(len(first)) + first
    if not len(starts):
        return none
    place = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    run = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    lo, hi, q = starts[run], starts[np.append(run[1:], len(starts)) - 1], place[run]
    context = roll.of(lo, hi + length) + (q - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (hi - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return np.searchsorted(off, lo, side="right") - 1, hashes[q], mixed(context), lo, hi


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns start a new value."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _packed(doc: np.ndarray) -> tuple[bytes, bytes]:
    """Runs of a column of ids: the ids and their counts."""
    at = np.flatnonzero(_runs(doc))
    return doc[at].astype(np.int64).tobytes(), np.diff(np.append(at, len(doc))).astype(np.uint32).tobytes()


def _unpacked(ids: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32))


def _group(doc: np.ndarray, num: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that a place belongs to; ``dedup`` deals rows alike."""
    return (doc % groups + (num >> np.uint64(32)).astype(np.int64) % groups) % groups


def _places(sub: int, num: np.ndarray) -> np.ndarray:
    """Numbers of the places of a text whose hash is ``sub``."""
    return num.astype(np.uint64) | np.uint64(sub) << np.uint64(32)


#: Rows of all steps: part is the bucket (kind 0: of contexts, 2: of single strings), or with kind 1 the group of
#: documents that marks are for.
_SCHEMA = "kind int, part int, ids binary, counts binary, nums binary, a binary, b binary, c binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 6]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, _KINDS, strict=True)], names=_NAMES)


def _by_part(kind: int, part: np.ndarray, doc: np.ndarray, num: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """A packed row for each part."""
    order = np.lexsort((num, doc, part))
    part, doc, num, columns = part[order], doc[order], num[order], [c[order] for c in columns]
    at = np.append(np.flatnonzero(_runs(part)), len(part)) if len(part) else [0]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield kind, int(part[a]), *_packed(doc[a:b]), num[a:b].astype(np.uint64).tobytes(), *[c[a:b].tobytes() for c in columns], *[b""] * (3 - len(columns))


def _marks(doc: np.ndarray, num: np.ndarray, mask: np.ndarray, groups: int) -> Iterator[tuple]:
    """Marks (which strings of a cover place go; bit 31: its context must be sent, with bit 0 as single strings) for the
    groups of the documents."""
    return _by_part(1, _group(doc, num, groups), doc, num, mask.astype(np.uint32))


ALL, ASKED, HOT = np.uint32(0x7FFFFFFF), np.uint32(0x80000000), np.uint32(0x80000001)


def _seen(length: int, gram: int):
    """(gram, context) hashes of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, off, data in pieces(batch.column(0), HASHED_BYTES):
                _, g, c, _, _ = covers(data, off, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.view(np.int64))], ["g", "c"])

    return run


def frequent_grams(rows: DataFrame, length: int, gram: int, least: int) -> np.ndarray:
    """Hashes of the grams with the most contexts in a sample of documents, ``FREQUENT_GRAMS`` at most."""
    some = rows.filter(F.pmod(F.xxhash64("id", "sub"), F.lit(SAMPLED)) == 0).select("text")
    per = some.mapInArrow(_seen(length, gram), "g long, c long").groupBy("g", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.count(F.lit(1)).alias("contexts"))
    many = per.filter(F.col("contexts") >= least).orderBy(F.desc("contexts"), "g").limit(FREQUENT_GRAMS)
    return np.sort(np.array([r["g"] for r in many.collect()], np.int64).view(np.uint64))


def _first_step(buckets: int, groups: int, length: int, gram: int, flush: int, frequent: np.ndarray = np.zeros(0, np.uint64)):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            doc, num, g, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, c, g))
            doc, num, g, c = doc[order], num[order], g[order], c[order]
            new = _runs(g, c)
            known = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else np.zeros(0, bool)
            often = ~known & np.isin(g, frequent)
            rows = list(_marks(doc[often], num[often], np.full(int(often.sum()), HOT), groups))
            rows += list(_marks(doc[known], num[known], np.full(int(known.sum()), ALL), groups))
            rest = ~known & ~often
            doc, num, g, c = doc[rest], num[rest], g[rest], c[rest]
            part = ((g >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            rows += _by_part(0, part, doc, num, g.astype(np.uint32), c.astype(np.uint32), (c >> np.uint64(32)).astype(np.uint16))
            return _batch(rows)

        for batch in batches:
            ids, subs = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.uint64)
            for first, off, data in pieces(batch.column(1), HASHED_BYTES):
                text, g, c, _, _ = covers(data, off, length, gram)
                num = (np.arange(len(text)) - np.searchsorted(text, text)).astype(np.uint64) | subs[first + text] << np.uint64(32)
                held.append((ids[first + text], num, g, c))
                size += len(data)
                if size >= flush:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[tuple]]]:
    """(rows of one bucket, rows that only pass through), from batches sorted by kind and part."""
    held: list[dict] = []
    for batch in batches:
        through = []
        for row in batch.to_pylist():
            if row["kind"] == 1:
                through.append(tuple(row.values()))
                continue
            if held and (held[0]["kind"], held[0]["part"]) != (row["kind"], row["part"]):
                yield held, []
                held = []
            held.append(row)
        if through:
            yield [], through
    if held:
        yield held, []


def _joined(rows: list[dict], **kinds: type) -> list[np.ndarray]:
    doc = np.concatenate([_unpacked(r["ids"], r["counts"]) for r in rows])
    return [doc, *(np.concatenate([np.frombuffer(r[name], kind) for r in rows]) for name, kind in kinds.items())]


def _first_buckets(groups: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, through in _parts(batches):
            if through:
                yield _batch(through)
                continue
            doc, num, g, low, high = _joined(rows, nums=np.uint64, a=np.uint32, b=np.uint32, c=np.uint16)
            c = (high.astype(np.uint64) << np.uint64(32)) | low
            order = np.lexsort((doc, c, g))
            doc, num, g, c = doc[order], num[order], g[order], c[order]
            new, head = _runs(g, c), _runs(g)
            known = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            heads = np.flatnonzero(head)
            least, most = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
            several = (np.add.reduceat(new.astype(np.int64), heads) > 1) & (least < most)
            asked = several[np.cumsum(head) - 1] & ~known
            many = (np.add.reduceat(asked.astype(np.int64), heads) > hot)[np.cumsum(head) - 1]
            mask = np.where(known, ALL, np.where(asked, np.where(many, HOT, ASKED), np.uint32(0)))
            use = mask > 0
            yield _batch(list(_marks(doc[use], num[use], mask[use], groups)))

    return run


def _marked(marks: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each (id, hash of the text), the numbers of the marked cover places, from 0, and their masks."""
    if not len(marks):
        return {}
    doc, num, mask = _joined(marks.select(["ids", "counts", "nums", "a"]).to_pylist(), nums=np.uint64, a=np.uint32)
    sub, num = (num >> np.uint64(32)).astype(np.int64), (num & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((sub, doc))
    doc, sub, num, mask = doc[order], sub[order], num[order], mask[order]
    at = np.append(np.flatnonzero(_runs(doc, sub)), len(doc))
    return {(int(doc[a]), int(sub[a])): (num[a:b], mask[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)}


def _documents(docs: pa.Table, length: int, gram: int) -> Iterator[tuple[tuple[int, int], np.ndarray, tuple[np.ndarray, ...]]]:
    """((id, hash of the text), bytes, covers) of each text of a group."""
    for chunk in docs.combine_chunks().to_batches():
        ids = list(zip(chunk.column("id").to_pylist(), chunk.column("sub").to_pylist(), strict=True))
        for first, off, data in pieces(chunk.column("text"), HASHED_BYTES):
            text, g, c, lo, hi = covers(data, off, length, gram)
            at = np.searchsorted(text, np.arange(len(off)))
            for i in range(len(off) - 1):
                a, b = at[i], at[i + 1]
                yield ids[first + i], data[off[i] : off[i + 1]], (g[a:b], lo[a:b] - off[i], hi[a:b] - off[i])


def _strings(data: np.ndarray, num: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(number of the place, bit, rank) of every string of some contexts of a text, in runs of its bytes."""
    parts, i = [], 0
    while i < len(num):
        j = max(i + 1, int(np.searchsorted(lo, lo[i] + HASHED_BYTES)))
        more = hi[i:j] - lo[i:j] + 1
        bit = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
        at = np.repeat(lo[i:j] - lo[i], more) + bit
        parts.append((np.repeat(num[i:j], more).astype(np.uint32), bit.astype(np.uint8), mixed(Rolling(data[lo[i] : hi[j - 1] + length]).of(at, at + length))))
        i = j
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _later(doc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which strings a smaller document has as well."""
    order = np.lexsort((doc, rank))
    own = doc[order]
    new = _runs(rank[order])
    gone = np.zeros(len(doc), bool)
    gone[order] = own > own[np.flatnonzero(new)][np.cumsum(new) - 1]
    return gone


def _bits(doc: np.ndarray, num: np.ndarray, bit: np.ndarray, groups: int) -> Iterator[tuple]:
    """Marks of single strings."""
    return _marks(doc, num, np.uint32(1) << bit.astype(np.uint32), groups)


def _second_step(buckets: int, groups: int, length: int, gram: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        found = _marked(marks)
        out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
        single: list[tuple[np.ndarray, ...]] = []
        seen = set()
        if any((m & ASKED).any() for _, m in found.values()):
            for name, data, (g, lo, hi) in _documents(docs, length, gram):
                num, mask = found.get(name, (None, None))
                if num is None or name in seen:
                    continue
                seen.add(name)  # a row that repeats id and text has the same places
                doc, sub = name
                ok = num < len(g)
                hot, num = np.sort(num[(mask == HOT) & ok]), num[(mask == ASKED) & ok]
                if len(hot):
                    at, *strings = _strings(data, hot, lo[hot], hi[hot], length)
                    single.append((np.full(len(at), doc, np.int64), _places(sub, at), *strings))
                raw = data.tobytes()
                out.append((doc, _places(sub, num), g[num], hi[num] - lo[num], [raw[a : b + length] for a, b in zip(lo[num].tolist(), hi[num].tolist(), strict=True)]))
        rows = []
        if out:
            doc = np.repeat([o[0] for o in out], [len(o[1]) for o in out])
            num, g, more = (np.concatenate([o[i] for o in out]) for i in (1, 2, 3))
            texts = [t for o in out for t in o[4]]
            part = ((g >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((num, doc, part))
            part = part[order]
            at = np.append(np.flatnonzero(_runs(part)), len(part)) if len(part) else [0]
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = order[a:b]
                rows.append((0, int(part[a]), *_packed(doc[own]), num[own].astype(np.uint64).tobytes(), more[own].astype(np.uint8).tobytes(), b"".join(texts[i] for i in own), b""))
        if single:
            doc, num, bit, rank = (np.concatenate(x) for x in zip(*single, strict=True))
            gone = _later(doc, rank)
            rows += _bits(doc[gone], num[gone], bit[gone], groups)
            doc, num, bit, rank = doc[~gone], num[~gone], bit[~gone], rank[~gone]
            rows += _by_part(2, ((rank >> np.uint64(32)) % np.uint64(SPREAD * buckets)).astype(np.int64), doc, num, bit, rank)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _second_buckets(groups: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, through in _parts(batches):
            if through:
                yield _batch(through)
                continue
            if rows[0]["kind"] == 2:
                doc, num, bit, rank = _joined(rows, nums=np.uint64, a=np.uint8, b=np.uint64)
                gone = _later(doc, rank)
                yield _batch(list(_bits(doc[gone], num[gone], bit[gone], groups)))
                continue
            doc, num, more = _joined(rows, nums=np.uint64, a=np.uint8)
            data = np.concatenate([np.frombuffer(r["b"], np.uint8) for r in rows])
            more = more.astype(np.int64)
            start = np.concatenate(([0], np.cumsum(more + length)[:-1]))
            owner = np.repeat(np.arange(len(doc)), more + 1)
            bit = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(more + 1)[:-1])), more + 1)
            at = start[owner] + bit
            rank = mixed(Rolling(data).of(at, at + length))
            order = np.lexsort((doc[owner], rank))
            own = doc[owner[order]]
            new = _runs(rank[order])
            gone = order[own > own[np.flatnonzero(new)][np.cumsum(new) - 1]]
            mask = np.zeros(len(doc), np.uint32)
            np.bitwise_or.at(mask, owner[gone], np.uint32(1) << bit[gone].astype(np.uint32))
            use = mask > 0
            yield _batch(list(_marks(doc[use], num[use], mask[use], groups)))

    return run


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that some ranges cover; ranges that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.append(True, start[1:] > end[:-1]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1] if len(first) else end


def _third_step(length: int, gram: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        found = _marked(marks)
        ids, sizes, kept, starts, ends, counts = [], [], [], [], [], []
        for name, data, (_, lo, hi) in _documents(docs, length, gram):
            ids.append(name[0])
            sizes.append(len(data))
            num, mask = found.get(name, (np.zeros(0, np.int64), np.zeros(0, np.uint32)))
            ok = num < len(lo)
            num, mask = num[ok].astype(np.int64), np.where(mask[ok] & ASKED, np.uint32(0), mask[ok])
            whole = mask == ALL
            row, bit = np.nonzero((mask[~whole, None] >> np.arange(31, dtype=np.uint32)) & np.uint32(1))
            at = lo[num[~whole]][row] + bit
            at = at[at + length <= len(data)]
            a, b = _union(np.concatenate((lo[num[whole]], at)), np.concatenate((hi[num[whole]], at)) + length)
            raw = memoryview(np.ascontiguousarray(data))
            kept.append(b"".join([raw[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)]))
            starts.append(a)
            ends.append(b)
            counts.append(len(a))
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in (starts, ends)], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), pa.int32()), spans)
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), lists], ["id", "n_bytes", "kept", "spans"])

    return run


def _prime(n: int) -> int:
    """The least prime from ``n`` on: ids that share a factor still spread over so many groups."""
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", key: str = "doc_id", hot: int = HOT_CONTEXTS, frequent_contexts: int = FREQUENT_CONTEXTS) -> DataFrame:
    """(key, n_bytes, kept, spans): the remaining bytes of each text and the maximal removed runs (start, end)."""
    if not 0 < length - gram < 31:
        raise ValueError("length must exceed gram by 1 to 30")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.col(text).alias("text"), F.xxhash64(text).bitwiseAND(0xFFFFFFFF).alias("sub"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, groups = max(1, -(-total // BUCKET_BYTES)), _prime(-(-total // GROUP_BYTES))
    many = max(tasks, -(-SPREAD * buckets // TASK_BUCKETS))
    frequent = frequent_grams(rows, length, gram, frequent_contexts)

    first = rows.mapInArrow(_first_step(buckets, groups, length, gram, FLUSH_BYTES, frequent), _SCHEMA)
    first = first.repartition(many, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(_first_buckets(groups, hot), _SCHEMA)
    first = stored(first)
    by_group = lambda df: df.repartition(max(tasks, -(-groups // TASK_GROUPS)), "part").groupBy("part")
    dealt = by_group(rows.withColumn("part", ((F.pmod("id", F.lit(groups)) + F.pmod("sub", F.lit(groups))) % groups).cast("int")))
    second = dealt.cogroup(by_group(first)).applyInArrow(_second_step(buckets, groups, length, gram), _SCHEMA)
    second = second.repartition(many, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(_second_buckets(groups, length), _SCHEMA)
    third = dealt.cogroup(by_group(first.unionByName(second))).applyInArrow(_third_step(length, gram), "id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
    return third.select(F.when(F.col("id") != LAST, F.col("id")).alias(key), "n_bytes", "kept", "spans")
