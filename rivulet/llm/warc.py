"""Operator 11: WARC records in ZIP packages, written and read back by ranges.

A package is a ZIP file whose members are stored as they are: ``archive/*.warc.gz``, each record of it a gzip member of its
own, ``indexes/*.cdxj`` with the offset and length of each record, and ``datapackage.json``. ``write`` makes packages of
pages; records of equal payloads are one response and revisits that refer to it. ``members`` reads the end of a package
alone, parses its central directory (ZIP64 too) and tells where stored members lie; ``runs`` turns their indexes into
ranges of neighbouring records; ``records`` reads those ranges in tasks of their own. Nothing is extracted, and neither
a package nor a member is ever read whole.

Packages lie in a folder that driver and executors share (any store that ``pyarrow.fs`` opens). A task writes to names of
its own and hands them on, so what a lost task leaves behind is never read.

Defined cases: a null payload is empty, and empty payloads are equal ones; of equal payloads that with the largest
(key, url) is the response, null below all others, and of rows that repeat it one; null keys are kept (their revisits refer
to a key, or null if the response's is); a null url is written as the record's own name, others as URIs; a long
payload is a record like others, in memory once; an empty table gives no packages and no records; further columns are
ignored, whatever their names. Archives without an index are read as one range; compressed or encrypted archive members
and cut-off packages are refused with ``ValueError``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import struct
import uuid
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import join_counted, scratch, stored

#: Bytes of an archive after which a task begins its next package, and of a range of records that is read at once.
PACKAGE_BYTES, RUN_BYTES = 256 << 20, 4 << 20
#: Bytes that a reader asks for at a time, and rows or bytes of a batch of results.
BLOCK, BATCH_BYTES, BATCH_ROWS = 1 << 20, 8 << 20, 10_000
#: Packages whose ends one task reads, and ranges that one task reads, about.
TASK_PACKAGES, TASK_RANGES = 16, 32
#: The date of records whose pages have none.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"
# Signatures and marks of the ZIP format.
END, END64, END64_AT, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
SHORT, LONG = 0xFFFF, 0xFFFFFFFF


# --- packages: where stored members lie ---


@dataclass(frozen=True)
class Member:
    name: str
    stored: bool
    size: int
    header: int


def opened(path: str) -> pa.NativeFile:
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def at(file: BinaryIO, start: int, size: int) -> bytes:
    """A range of a file; ``ValueError`` if the file ends before."""
    file.seek(start)
    out = file.read(size)
    if len(out) != size:
        raise ValueError(f"cut off: {size} bytes asked for at {start}, {len(out)} there")
    return out


def directory(file: BinaryIO, size: int) -> tuple[int, int, int, int]:
    """(start, bytes, entries) of the central directory, and what stands before the package in its file."""
    tail_at = max(0, size - 22 - SHORT)
    tail = at(file, tail_at, size - tail_at)
    i = tail.rfind(END)
    while i >= 0 and (len(tail) < i + 22 or i + 22 + int.from_bytes(tail[i + 20 : i + 22], "little") > len(tail)):
        i = tail.rfind(END, 0, i)  # the signature may stand in the comment
    if i < 0:
        raise ValueError("no end of a central directory")
    entries, held, start = struct.unpack("<HII", tail[i + 10 : i + 20])
    end = tail_at + i
    if SHORT == entries or LONG in (held, start):
        if end >= 20 and (place := at(file, end - 20, 20))[:4] == END64_AT:
            told = int.from_bytes(place[8:16], "little")
            # the record is fixed in size but for data that may follow it; it ends where its locator begins
            for end64 in (told, end - 20 - 56):
                if 0 <= end64 <= end - 76 and (record := at(file, end64, 56))[:4] == END64:
                    break
            else:
                raise ValueError("no ZIP64 end of a central directory")
            entries, held, start = struct.unpack("<QQQ", record[32:56])
            end = end64
    if held > end or end - held < start:
        raise ValueError("the central directory doesn't fit before its end")
    return end - held, held, entries, end - held - start


def entries(raw: bytes, count: int, shift: int) -> Iterator[Member]:
    """The members that a central directory lists."""
    p = 0
    for _ in range(count):
        if raw[p : p + 4] != ENTRY or len(raw) < p + 46:
            raise ValueError(f"no entry of a central directory at {p}")
        flags, method = struct.unpack("<HH", raw[p + 8 : p + 12])
        packed, size, n, more, note = struct.unpack("<IIHHH", raw[p + 20 : p + 34])
        header = int.from_bytes(raw[p + 42 : p + 46], "little")
        name = raw[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[p + 46 + n : p + 46 + n + more]
        while len(extra) >= 4:
            kind, length = struct.unpack("<HH", extra[:4])
            body, extra = extra[4 : 4 + length], extra[4 + length :]
            if kind == 1:  # the long fields stand in this order, each only where the short one is full
                longs = iter(struct.unpack(f"<{len(body) // 8}Q", body[: len(body) // 8 * 8]))
                size = next(longs) if size == LONG else size
                packed = next(longs) if packed == LONG else packed
                header = next(longs) if header == LONG else header
        yield Member(name, method == 0 and not flags & 1 and packed == size, size, header + shift)
        p += 46 + n + more + note


def listed(file: BinaryIO, size: int) -> list[Member]:
    start, held, count, shift = directory(file, size)
    return list(entries(at(file, start, held), count, shift))


def kind_of(name: str) -> str | None:
    base = name.removesuffix(".gz")
    if name.startswith("archive/") and base.endswith(".warc"):
        return "archive"
    return "index" if name.startswith("indexes/") and base.endswith((".cdx", ".cdxj")) else None


def data_start(file: BinaryIO, member: Member) -> int:
    """Where a member's bytes begin: its local header says how long it is itself."""
    head = at(file, member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no member at {member.header}")
    n, more = struct.unpack("<HH", head[26:30])
    return member.header + 30 + n + more


def located(file: BinaryIO, size: int) -> Iterator[tuple[str, str, int, int]]:
    """(kind, name, start, size) of the archives and indexes of a package."""
    for m in listed(file, size):
        if kind := kind_of(m.name):
            if not m.stored:
                raise ValueError(f"{m.name} is compressed or encrypted: its records have no ranges")
            yield kind, m.name, data_start(file, m), m.size


def members(packages: DataFrame, path: str = "path") -> DataFrame:
    """(package, kind, name, start, size): the stored archives and indexes of packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0).to_pylist():
                with opened(package) as file:
                    rows = [(package, *x) for x in located(file, file.size())]
                yield _batch(rows, [("package", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("start", pa.int64()), ("size", pa.int64())])

    return packages.select(path).mapInArrow(run, "package string, kind string, name string, start long, size long")


def _dealt(rows: DataFrame, per_task: int, *by: str) -> DataFrame:
    """Few small rows that stand for much work, ``per_task`` in a task, and in as many tasks as run at a time if they reach."""
    n = rows.count()
    return rows.repartition(max(1, math.ceil(n / per_task), min(n, rows.sparkSession.sparkContext.defaultParallelism)), *by)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


# --- indexes: ranges of records ---


class Range:
    """A range of a file as a file of its own, read in blocks."""

    def __init__(self, file: BinaryIO, start: int, size: int):
        self.file, self.next, self.end = file, start, start + size

    def read(self, n: int = -1) -> bytes:
        n = self.end - self.next if n < 0 else min(n, self.end - self.next)
        out = at(self.file, self.next, n) if n else b""
        self.next += n
        return out

    def blocks(self) -> Iterator[bytes]:
        while block := self.read(BLOCK):
            yield block


def plain(blocks: Iterator[bytes], packed: bool) -> Iterator[bytes]:
    """The bytes of gzip members that follow one another, or the bytes themselves."""
    if not packed:
        yield from blocks
        return
    member = zlib.decompressobj(31)
    begun = False
    for block in blocks:
        full = False  # more may come out than was asked for, though all has gone in
        while block or full:
            out = member.decompress(block, BLOCK)
            begun, full = True, len(out) == BLOCK
            if out:
                yield out
            block = member.unconsumed_tail
            if member.eof:
                block, member, begun, full = member.unused_data, zlib.decompressobj(31), False, False
    if begun:
        raise ValueError("cut off: a gzip member doesn't end")


class Source:
    """Bytes that arrive in blocks, read by line and by count."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, bytearray()

    def more(self) -> bool:
        block = next(self.blocks, None)
        if block is not None:
            self.held += block
        return block is not None

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``, which is passed over; None if nothing is left."""
        seen = 0
        while (i := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("cut off: a record doesn't end")
                return None
        out = bytes(self.held[:i])
        del self.held[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("cut off: a record doesn't end")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def indexed(blocks: Iterator[bytes], packed: bool) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of the lines of an index."""
    source = Source(plain(blocks, packed))
    ended = False
    while not ended:
        try:
            line = source.until(b"\n")
        except ValueError:  # the last line needs no end
            line, ended = bytes(source.held), True
        if line is None:
            return
        brace = line.find(b"{")
        if brace >= 0:
            told = json.loads(line[brace:])
            yield told["filename"], int(told["offset"]), int(told["length"])


def joined_runs(offset: np.ndarray, length: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Neighbouring records as (start, size), of about ``most`` bytes at most."""
    order = np.argsort(offset, kind="stable")
    start = end = None
    for o, n in zip(offset[order].tolist(), length[order].tolist(), strict=True):
        if start is not None and o == end and end - start < most:
            end = o + n
        elif start is not None and o < end:
            raise ValueError(f"records overlap at {o}")
        else:
            if start is not None:
                yield start, end - start
            start, end = o, o + n
    if start is not None:
        yield start, end - start


def _package_runs(file: BinaryIO, size: int) -> Iterator[tuple[str, int, int]]:
    found = list(located(file, size))
    places = {name.rpartition("/")[2]: (array("q"), array("q")) for kind, name, _, _ in found if kind == "archive"}
    for kind, name, start, held in found:
        if kind == "index":
            for archive, offset, length in indexed(Range(file, start, held).blocks(), name.endswith(".gz")):
                if own := places.get(archive.rpartition("/")[2]):
                    own[0].append(offset)
                    own[1].append(length)
    for kind, name, start, held in found:
        if kind == "archive":
            offset, length = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in places[name.rpartition("/")[2]])
            if len(offset) and int((offset + length).max()) > held:
                raise ValueError(f"the index leads out of {name}")
            for first, n in joined_runs(offset, length) if len(offset) else [(0, held)]:
                yield name, start + first, n


def runs(packages: DataFrame, path: str = "path") -> DataFrame:
    """(package, name, start, size): ranges of a package's file that hold whole records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0).to_pylist():
                with opened(package) as file:
                    rows = [(package, *x) for x in _package_runs(file, file.size())]
                yield _batch(rows, [("package", pa.string()), ("name", pa.string()), ("start", pa.int64()), ("size", pa.int64())])

    return _dealt(packages.select(path), TASK_PACKAGES, path).mapInArrow(run, "package string, name string, start long, size long")


# --- records ---


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parsed(source: Source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of WARC records that follow one another."""
    while (head := source.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {head[:20]!r}")
        told = fields(head)
        yield told, source.take(int(told["content-length"]))
        source.take(4)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


RECORD = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())]


def records(ranges: DataFrame, payload: bool = True) -> DataFrame:
    """The records in ranges of packages: RECORD's columns, and payload (null for revisits).

    payload_bytes and payload_digest are those of the full payload: of a response as read, of a revisit as it says;
    ``intact`` is whether what was read has the digest that the record gives.
    """
    columns = [*RECORD, *([("payload", pa.binary())] if payload else [])]
    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}

    def row(told: dict[str, str], block: bytes) -> tuple:
        kind, digest = told.get("warc-type"), told.get("warc-payload-digest", "").rpartition(":")[2] or None
        head, split, body = block.partition(b"\r\n\r\n")
        http = told.get("content-type", "").startswith("application/http")
        length, whole = None, None
        if kind == "revisit":
            length = int(fields(head).get("content-length", -1)) if http else -1
            length, intact = (None if length < 0 else length), digest is not None
        else:
            whole = body if http and split else b"" if http else block
            length, own = len(whole), base32_sha1(whole)
            digest, intact = own, digest is None or digest == own
        bare = lambda x: x[1:-1] if x and x[:1] == "<" else x
        own = (bare(told.get("warc-record-id")), kind, bare(told.get("warc-target-uri")), told.get("warc-date"), bare(told.get("warc-refers-to")), length, digest, intact)
        return (*own, whole) if payload else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for package, name, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(package) as file:
                    for told, block in parsed(Source(plain(Range(file, start, size).blocks(), name.endswith(".gz")))):
                        rows.append(row(told, block))
                        held += len(block) if payload else 0
                        if held > BATCH_BYTES or len(rows) == BATCH_ROWS:
                            yield _batch(rows, columns)
                            rows, held = [], 0
        yield _batch(rows, columns)

    # ranges of one package go to many tasks
    dealt = _dealt(stored(ranges.select("package", "name", "start", "size")), TASK_RANGES, "package", "start")
    return dealt.mapInArrow(run, ", ".join(f"{n} {kinds[k]}" for n, k in columns))


def read(packages: DataFrame, path: str = "path", payload: bool = True) -> DataFrame:
    """All records of packages; see ``records``."""
    return records(runs(packages, path), payload)


# --- writing ---


def as_uri(url: str) -> str:
    """``url`` with blanks, controls and non-ASCII characters as escapes; those that it has stay."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def surt(url: str) -> str:
    """The sort key of a url: its host from the last name to the first, then the rest."""
    parts = urlsplit(url)
    host = ",".join(reversed((parts.hostname or "").split(".")))
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower().replace(" ", "%20")


def record(kind: str, name: str, url: str, digest: str, size: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A WARC record with an HTTP head; a revisit holds the head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": f"sha1:{digest}"}
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head.items())]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Stream:
    """What a ZIP writer may use of a stream that can't go back."""

    def __init__(self, out: BinaryIO):
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass


class Package:
    """A package that is being written, record by record."""

    def __init__(self, folder: str):
        store, inner = fs.FileSystem.from_uri(folder)
        name = uuid.uuid4().hex
        self.path = f"{folder}/{name}.wacz"
        self.out = store.open_output_stream(f"{inner}/{name}.wacz")
        self.zip = zipfile.ZipFile(_Stream(self.out), "w", zipfile.ZIP_STORED)
        self.archive = f"{name}.warc.gz"
        self.member = self.zip.open(self._info(f"archive/{self.archive}"), "w", force_zip64=True)
        self.size, self.lines, self.sha = 0, [], hashlib.sha256()

    @staticmethod
    def _info(name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))

    def add(self, raw: bytes, url: str, date: str, digest: str, kind: str) -> None:
        packed = gzip.compress(raw, 4, mtime=0)
        told = {"url": url, "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": f"sha1:{digest}", "filename": self.archive, "offset": str(self.size), "length": str(len(packed))}
        self.lines.append(f"{surt(url)} {''.join(c for c in date if c.isdigit())} {json.dumps(told)}\n")
        self.member.write(packed)
        self.sha.update(packed)
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        """(path, records, bytes of the archive)."""
        self.member.close()
        index = "".join(sorted(self.lines)).encode()
        self.zip.writestr(self._info("indexes/index.cdxj"), index)
        resources = [(f"archive/{self.archive}", self.sha.hexdigest(), self.size), ("indexes/index.cdxj", hashlib.sha256(index).hexdigest(), len(index))]
        told = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": p.rpartition("/")[2], "path": p, "hash": f"sha256:{h}", "bytes": n} for p, h, n in resources]}
        self.zip.writestr(self._info("datapackage.json"), json.dumps(told))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.size


def decided(pages: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """(key, url, digest, size, payload, name, refers_to) of every record; payload and refers_to: one of them is null.

    Digests are compared in a slim table; whole pages are joined only with the digests that several rows have.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long"))
    slim = stored(rows.select("key", "url", "digest", "size").withColumn("row", F.monotonically_increasing_id()))
    same = slim.filter(F.col("size") >= least).groupBy("digest", "key", "url").agg(F.count(F.lit(1)).alias("m"), F.max("row").alias("row"))
    per = same.groupBy("digest").agg(F.sum("m").alias("n"), F.max(F.struct("key", "url", "m", "row")).alias("best"))
    per = stored(per.filter("n > 1"))
    total = slim.count()
    name = lambda k, *more: F.concat(F.lit(NAME), F.coalesce(k.cast("string"), F.lit("null")), *[x for m in more for x in (F.lit(":"), m)])
    again = join_counted(slim, per, ["digest"], "n", total).filter(F.col("row") != F.col("best.row"))
    again = again.select("key", "url", "digest", "size", F.lit(None).cast("binary").alias("payload"), name(F.col("key"), F.col("digest"), F.col("row").cast("string")).alias("name"), name(F.col("best.key"), F.col("digest")).alias("refers_to"))
    met = join_counted(rows, per, ["digest"], "n", total, "left")
    mine = F.col("best").isNull() | (F.col("key").eqNullSafe(F.col("best.key")) & F.col("url").eqNullSafe(F.col("best.url")))
    met = met.filter(mine)
    repeated = F.coalesce(F.col("best.m") > 1, F.lit(False))
    first = met.filter(~repeated).unionByName(met.filter(repeated).dropDuplicates(["digest"]))
    # payloads below the least size may be equal: their names differ by their rows
    unlike = F.when(F.col("size") < least, F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"))).otherwise("")
    first = first.select("key", "url", "digest", "size", "payload", F.concat(name(F.col("key"), F.col("digest")), unlike).alias("name"), F.lit(None).cast("string").alias("refers_to"))
    return first.unionByName(again)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = DATE, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages to ``folder`` and returns (path, n_records, archive_bytes), a stored table of them.

    Of pages with equal payloads of at least ``least`` bytes one is a response and the others revisit it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        package, done = None, []
        for batch in batches:
            for link, digest, size, payload, name, refers_to in zip(*batch.columns, strict=True):
                package = package or Package(folder)
                link, name, refers_to, payload = link.as_py(), name.as_py(), refers_to.as_py(), payload.as_py()
                kind = "response" if refers_to is None else "revisit"
                target = name if link is None else as_uri(link)
                digest = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                package.add(record(kind, name, target, digest, size.as_py(), payload or b"", refers_to, date), target, date, digest, kind)
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield _batch(done, [("path", pa.string()), ("n_records", pa.int64()), ("archive_bytes", pa.int64())])

    rows = decided(pages, key, url, html, least).select("url", "digest", "size", "payload", "name", "refers_to")
    return stored(rows.mapInArrow(run, "path string, n_records long, archive_bytes long"))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, intact) of every page, as read back from packages."""
    out = read(write(pages, scratch(pages.sparkSession), key, url, html, least), payload=False)
    page = lambda c: F.nullif(F.split_part(F.substring(c, len(NAME) + 1, 1 << 30), F.lit(":"), F.lit(1)), F.lit("null")).cast("long")
    return out.select(page("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "intact")


def page_url(target_uri: str) -> str | None:
    """The url of a record of ``write``, as a URI; null if its page had none."""
    return None if target_uri.startswith(NAME) else target_uri
