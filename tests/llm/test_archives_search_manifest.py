"""Operators 11 to 13 against brute force, other readers, and their defined cases."""

import base64
import hashlib
import io
import math
import random
import re
import zipfile
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rivulet.llm import common, merkle, search, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


# --- 13 ---


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests):
    """Levels of digests, and each leaf's (left, right) siblings."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for i in range(len(digests)):
        path = []
        for level in levels[:-1]:
            a = i // 16 * 16
            run = level[a : a + 16]
            path.append(("".join(run[: i - a]), "".join(run[i - a + 1 :])))
            i //= 16
        paths.append(path)
    return levels, paths


def plain_manifest(rows, tampered):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    own = lambda r, text: sha(*map(field, (r[0], r[3], r[2], r[4], text)))
    by = defaultdict(list)
    for r in rows:
        text = r[1]
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        by[r[3]].append((r[0], own(r, text), own(r, low if tampered(r[0]) else text)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        leaves = sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = (leaves, *plain_tree([x[1] for x in leaves]))
    top, above = plain_tree([trees[s][1][-1][0] for s in names])
    out = []
    for s, over in zip(names, above, strict=True):
        leaves, levels, paths = trees[s]
        for (key, digest, found), path in zip(leaves, paths, strict=True):
            fold = found
            for left, right in [*path, *over]:
                fold = sha(left, fold, right)
            out.append((key, digest, levels[-1][0], top[-1][0], sha(*[x for p in [*path, *over] for x in p]), fold, fold == top[-1][0]))
    return out


def odd_documents():
    rng = random.Random(5)
    rows = [(i, f"Text {i} {'X' * (i % 7)}", "en", "big", i) for i in range(700)]
    rows += [(1000 + i, f"Ábc {i}", None, f"s{i:03d}", None) for i in range(40)]  # more sources than one run
    rows += [(2000 + i, None if i % 3 else "", "de", None, 0) for i in range(17)]
    rows += [(3000 + i, "a", "", "", -5) for i in range(16)]
    rows += [(7, "Text again", "en", "big", 1)] * 5 + [(None, "no key", "en", "big", 1)] * 2
    rows += [(4000, "Long " * 300_000, "en", "long", 9)]
    rng.shuffle(rows)
    return rows


def key_of(row):
    return tuple((x is None, str(x)) for x in row)


def test_manifest_against_plain_trees(spark):
    rows = odd_documents()
    out = merkle.verified(merkle.proofs(docs_of(spark, rows), tampered=F.col("doc_id") % 3 == 0))
    expected = plain_manifest(rows, lambda k: k is not None and k % 3 == 0)
    assert sorted(map(tuple, out.collect()), key=key_of) == sorted(expected, key=key_of)
    assert 0 < sum(1 for r in expected if not r[-1]) < len(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_of_full_and_uneven_levels(spark, n):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(n)]
    out = merkle.verified(merkle.proofs(docs_of(spark, rows)))
    assert sorted(map(tuple, out.collect())) == sorted(plain_manifest(rows, lambda k: False))


def test_manifest_nodes_cover_their_intervals(spark):
    rows = odd_documents()
    got = merkle.manifest(docs_of(spark, rows)).collect()
    sizes = Counter(r[3] for r in rows)
    for source, n in sizes.items():
        own = [r for r in got if r["tree"] == 0 and r["no_group"] == (source is None) and r["group"] == (source or "")]
        by = defaultdict(list)
        for r in own:
            by[r["level"]].append((r["lo"], r["hi"]))
        assert len(by[0]) == n and by[max(by)] == [(0, n)]
        for level, intervals in by.items():  # each level covers all leaves once
            intervals.sort()
            assert intervals[0][0] == 0 and intervals[-1][1] == n and all(a[1] == b[0] for a, b in zip(intervals, intervals[1:], strict=False)), level
    assert len([r for r in got if r["tree"] == 1 and r["level"] == 0]) == len(sizes)


def test_manifest_ignores_further_columns_and_empty_tables(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(20)]
    df = docs_of(spark, rows)
    names = "key no_group group leaf found index g n first lo hi digest kids bucket path root subroot __place __at __part __n __first".split()
    clashing = df.select("*", *[F.lit("x").alias(c) for c in names])
    assert sorted(map(tuple, merkle.verified(merkle.proofs(clashing)).collect())) == sorted(plain_manifest(rows, lambda k: False))
    assert merkle.verified(merkle.proofs(df.limit(0))).count() == 0 and merkle.manifest(df.limit(0)).count() == 0


def apart(spark):
    """``stored`` without joining small partitions."""

    def stored(df):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = common.stored(df)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        return out

    return stored


def test_a_hot_source_is_ranked_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "stored", apart(spark))
    df = spark.range(40_000).select(F.lit(3).cast("long").alias("key"), F.lit(False).alias("no_group"), F.lit("s").alias("group"), F.lit("x").alias("leaf"))
    out = merkle.numbered(df.repartition(4), [F.col("no_group").desc(), F.col("group"), F.col("key"), F.col("leaf")])
    assert [r[0] for r in out.select("index").orderBy("index").collect()] == list(range(40_000))
    sizes = [pq.read_metadata(f.removeprefix("file:")).num_rows for f in {f.replace("file://", "file:") for f in out.inputFiles()}]
    assert sum(n > 0 for n in sizes) >= 4 and max(sizes) < 20_000  # equal rows are split too


# --- 12 ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def plain_search(docs, items, k=10):
    terms = {j: TERM.findall((t or "").translate(LOW)) for j, (_, t) in enumerate(docs)}
    big_n, big_l = sum(1 for t in terms.values() if t), sum(map(len, terms.values()))
    df = Counter(w for t in terms.values() for w in set(t))
    weight = {w: math.floor(1000 * math.log((2 * big_n + 2) / (2 * c + 1))) for w, c in df.items()}
    out = []
    for item, text in items:
        found = []
        for j, (doc, _) in enumerate(docs):
            n, tf, score = len(terms[j]), Counter(terms[j]), 0
            if n:
                m = 100 - 75 + 75 * n * big_n // big_l
                for w in TERM.findall((text or "").translate(LOW)):
                    if tf[w]:
                        score += weight[w] * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=key_of)


def searched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    return sorted((tuple(r) for r in search.search(d, q, **more).collect()), key=key_of)


def odd_texts(n=200):
    rng = random.Random(3)
    words = ["the", "The", "naïve", "ÉTÉ", "a1", "x", "日本", "co", "op", "\x80y", "under_score", "tab\tin", "nul\x00in", "ß", "İ"]
    text = lambda: rng.choice(["", " ", "-"]) + rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(words, k=rng.randint(0, 12)))
    docs = [(i, text()) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "--- !"), (5, text()), (None, "the naïve op"), (None, "the naïve op"), (n + 3, "the"), (n + 4, "the")]
    return docs, [(i, text()) for i in range(15)] + [(15, None), (16, "..."), (17, "the the The x"), (17, "日本"), (None, "op co")]


def test_search_against_brute_force(spark):
    docs, items = odd_texts()
    assert searched(spark, docs, items) == plain_search(docs, items)


def test_search_in_blocks_of_items(spark):
    docs, items = odd_texts(60)
    assert searched(spark, docs, items, block_items=4, k=3) == plain_search(docs, items, k=3)


def test_search_reads_long_texts_in_runs(spark, monkeypatch):
    docs = [(0, "alpha beta-gamma " * 90_000 + "delta"), (1, "w" * 1_500_000 + " beta"), (2, "delta alpha"), (3, "deltaalpha")]
    items = [(0, "alpha delta"), (1, "gamma"), (2, "beta beta")]
    assert searched(spark, docs, items) == plain_search(docs, items)


def test_search_of_nothing(spark):
    docs, items = odd_texts(5)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == [] and searched(spark, [(1, None), (2, "!")], items) == []


def test_search_ignores_further_columns(spark):
    docs, items = odd_texts(30)
    names = "item term times block number row rank score what n doc t".split()
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("z").alias(c) for c in names])
    q = spark.createDataFrame(items, "item_id long, text string").select("*", *[F.lit("z").alias(c) for c in names])
    assert sorted((tuple(r) for r in search.search(d, q).collect()), key=key_of) == plain_search(docs, items)


def test_terms_of_neighbouring_texts_stay_apart():
    v = search.vocabulary(pa.table({"item": pa.array([0, 0], pa.int64()), "term": ["ab", "b"], "times": pa.array([1, 2], pa.int64())}))
    (first, terms, text, term, tf), *more = search.counted(v, pa.array(["a", "b", "", None, "ab b", "b"]))
    assert first == 0 and not more and terms.tolist() == [1, 1, 0, 0, 2, 1]
    names = {i: t.decode("latin-1") for t, i in ((b"ab", 0), (b"b", 1))}
    assert [(x, names[y], z) for x, y, z in zip(text.tolist(), term.tolist(), tf.tolist(), strict=True)] == [(1, "b", 1), (4, "ab", 1), (4, "b", 1), (5, "b", 1)]


# --- 11 ---


def base32(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def odd_pages():
    rows = [(i, f"https://h{i % 3}.example/p {i}?q=ä&x=%20", f"<p>page {i}</p>") for i in range(60)]
    rows += [(100 + i, f"http://a.example/{i}", "<p>copy</p>") for i in range(400)]
    rows += [(600 + i, None, None if i % 2 else "") for i in range(5)]
    rows += [(700, "http://a.example/", "twice")] * 3 + [(None, "http://b.example/", "keyless"), (None, None, "keyless"), (None, "http://c.example/", "<p>page 1</p>")]
    rows += [(800, "http://l.example/", "lang é " * 400_000), (801, "http://l.example/\r\nX: y", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\n")]
    return rows


def test_pages_come_back(spark):
    rows = odd_pages()
    out = [tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()]
    tops = {}
    for key, _, html in rows:
        tops[html or ""] = max(tops.get(html or "", -1), -1 if key is None else key)
    expected, first = [], set()
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        html = html or ""
        top = None if tops[html] < 0 else tops[html]
        is_first = key == top and html not in first
        first |= {html} if is_first else set()
        expected.append((key, len(html.encode()), base32(html), "response" if is_first else "revisit", None if is_first else top, True))
    assert sorted(out, key=key_of) == sorted(expected, key=key_of)


def test_small_payloads_are_all_responses(spark):
    rows = [(i, None, "ab") for i in range(3)] + [(10 + i, None, "abcd") for i in range(3)]
    out = warc.round_trip(spark.createDataFrame(rows, PAGES), least=3).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in out} == {(0, "response", None), (1, "response", None), (2, "response", None), (10, "revisit", 12), (11, "revisit", 12), (12, "response", None)}


def packages_of(spark, rows, folder, **more):
    return [r["path"] for r in warc.write(spark.createDataFrame(rows, PAGES).repartition(2), f"file://{folder}", **more).collect()]


def test_other_readers_open_the_packages(spark, tmp_path):
    rows = odd_pages()
    seen = Counter()
    for path in packages_of(spark, rows, tmp_path, package_bytes=2000):
        with zipfile.ZipFile(path.removeprefix("file://")) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            (archive,) = [n for n in z.namelist() if n.startswith("archive/")]
            import gzip

            text = gzip.decompress(z.read(archive))
            kinds = re.findall(rb"^WARC-Type: (\w+)\r$", text, re.M)
            assert len(z.read("indexes/index.cdxj").splitlines()) == len(kinds)
            seen.update(kinds)
    assert seen[b"response"] == len({r[2] or "" for r in rows}) and sum(seen.values()) == len(rows)


def test_records_keep_payloads_and_urls(spark, tmp_path):
    rows = odd_pages()
    packages = spark.createDataFrame([(p,) for p in packages_of(spark, rows, tmp_path)], "path string")
    got = warc.read(packages).collect()
    assert Counter(r["payload"].decode() for r in got if r["record_type"] == "response") == Counter({r[2] or "" for r in rows})
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit") and all(r["intact"] for r in got)
    assert Counter(warc.page_url(r["target_uri"]) for r in got) == Counter(r[1] and warc.as_uri(r[1]) for r in rows)
    assert warc.as_uri("http://x/%20 ä\n") == "http://x/%20%20%C3%A4%0A"
    ids = [r["record_id"] for r in got]
    assert len(set(ids)) == len(ids) and {r["refers_to"] for r in got} - {None} <= set(ids)


def archive(*texts):
    import gzip

    raw = [warc.record("response", f"urn:x:{i}", "http://x/", base32(t), len(t), t.encode(), None, warc.DATE) for i, t in enumerate(texts)]
    return [gzip.compress(r) for r in raw]


def test_directories_are_parsed_like_the_library_does(tmp_path):
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(66_000):  # more than the short form can count
            z.writestr(f"n{i}", b"")
        z.writestr("archive/é.warc", b"abc")
    prefixed = io.BytesIO(b"#!/bin/sh\nexit\n" + many.getvalue())
    noted = io.BytesIO()
    with zipfile.ZipFile(noted, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/x.warc.gz", b"12345", zipfile.ZIP_STORED)
        z.writestr("pages/pages.jsonl", b"{}" * 100)
    comment = b"a comment with PK\x05\x06 in it, and more than twenty-two bytes behind it"
    commented = io.BytesIO(noted.getvalue()[:-2] + len(comment).to_bytes(2, "little") + comment)
    for raw, library, shift in ((many, many, 0), (prefixed, many, 15), (noted, noted, 0), (commented, noted, 0)):
        with zipfile.ZipFile(library) as z:
            expected = [(i.filename, i.compress_type == 0, i.file_size, i.header_offset + shift) for i in z.infolist()]
        got = warc.listed(raw, len(raw.getvalue()))
        assert [(m.name, m.stored, m.size, m.header) for m in got] == expected
        for kind, _, start, size in warc.located(raw, len(raw.getvalue())):
            assert kind == "archive" and raw.getvalue()[start : start + size] in (b"abc", b"12345")


def test_long_fields_of_a_sparse_file(tmp_path):
    """Offsets beyond 4 GB: a package whose first member is a hole."""
    path = tmp_path / "sparse.wacz"
    hole = 5 << 30
    with open(path, "wb") as f:
        f.seek(hole)
        name, data = b"archive/a.warc", b"WARC"
        f.write(warc.LOCAL + b"\x2d\x00" + bytes(8) + bytes(4) + (4).to_bytes(4, "little") * 2 + len(name).to_bytes(2, "little") + bytes(2) + name + data)
        start = f.tell()
        extra = b"\x01\x00\x08\x00" + hole.to_bytes(8, "little")
        f.write(warc.ENTRY + bytes(16) + (4).to_bytes(4, "little") * 2 + len(name).to_bytes(2, "little") + len(extra).to_bytes(2, "little") + bytes(10) + b"\xff" * 4 + name + extra)
        end = f.tell()
        f.write(warc.END64 + (44).to_bytes(8, "little") + bytes(12) + (1).to_bytes(8, "little") * 2 + (end - start).to_bytes(8, "little") + start.to_bytes(8, "little"))
        f.write(warc.END64_AT + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little"))
        f.write(warc.END + bytes(4) + b"\xff\xff" * 2 + b"\xff" * 8 + bytes(2))
    with warc.opened(str(path)) as f:
        assert list(warc.located(f, f.size())) == [("archive", "archive/a.warc", hole + 30 + len(name), 4)]


def test_archives_of_others(spark, tmp_path):
    """No index, a packed index of some records, plain archives; what can't be read by ranges is refused."""
    import gzip

    parts = archive("one", "two", "x" * 3_000_000)
    plain = b"".join(gzip.decompress(p) for p in parts)
    line = '- 1 {"filename": "b.warc.gz", "offset": "%d", "length": "%d"}'
    index = (line % (len(parts[0]), len(parts[1]))).encode()
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", b"".join(parts))
        z.writestr("archive/c.warc", plain)
    with zipfile.ZipFile(tmp_path / "b.wacz", "w") as z:
        z.writestr("archive/b.warc.gz", b"".join(parts))
        z.writestr("indexes/index.cdx.gz", gzip.compress(index))
        z.writestr("archive/empty.warc.gz", b"")
    read = lambda *names: sorted(len(r["payload"]) for r in warc.read(spark.createDataFrame([(str(tmp_path / n),) for n in names], "path string")).collect())
    assert read("a.wacz") == [3, 3, 3, 3, 3_000_000, 3_000_000] and read("b.wacz") == [3]
    with zipfile.ZipFile(tmp_path / "c.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", b"".join(parts))
    whole = (tmp_path / "a.wacz").read_bytes()
    for name, raw in (("d.wacz", whole[:-30]), ("e.wacz", b""), ("f.wacz", b"PK" * 50)):
        (tmp_path / name).write_bytes(raw)
    for name in ("c.wacz", "d.wacz", "e.wacz", "f.wacz"):
        with pytest.raises(Exception, match="ValueError"):
            read(name)
    for broken in (b"".join(parts)[:-5], plain[:-5], b"nonsense\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parsed(warc.Source(warc.plain(iter([broken]), broken[:2] == b"\x1f\x8b"))))


def test_ranges_join_neighbours():
    import numpy as np

    offset, length = np.array([30, 0, 10, 50]), np.array([10, 10, 20, 5])
    assert list(warc.joined_runs(offset, length)) == [(0, 40), (50, 5)]
    assert list(warc.joined_runs(offset, length, most=10)) == [(0, 10), (10, 20), (30, 10), (50, 5)]
    with pytest.raises(ValueError):
        list(warc.joined_runs(np.array([0, 5]), np.array([10, 10])))


def test_packed_blocks_that_end_anywhere():
    raw = b"".join(archive("a" * (3 << 20), "b", ""))
    for step in (1, 7, 4096, len(raw)):
        if step > 1 or len(raw) < 20_000:
            blocks = (raw[i : i + step] for i in range(0, len(raw), step))
            assert [len(b.split(b"\r\n\r\n", 1)[1]) for _, b in warc.parsed(warc.Source(warc.plain(blocks, True)))] == [3 << 20, 1, 0]


def test_pages_with_further_columns_and_empty_tables(spark):
    rows = odd_pages()[:30]
    df = spark.createDataFrame(rows, PAGES)
    names = "key digest size payload row m n best name refers_to record_type payload_bytes".split()
    clashing = df.select("*", *[F.lit("z").alias(c) for c in names])
    assert warc.round_trip(clashing).count() == 30 and warc.round_trip(df.limit(0)).count() == 0
