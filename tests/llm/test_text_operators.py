"""Operators on texts against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import classifier, embed_lsh, graph, html, langid, line_dedup, minhash, mixing, oracles, packing, quality_rules, queries, suffix_dedup
from tests.compare import assert_same, connected

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in enumerate(texts)], DOCS).repartition(3)


def union_find(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def con():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF), con.sql(oracles.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_table(spark, tmp_path, name):
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_quality_rules(spark):
    rows = {r["doc_id"]: r for r in quality_rules.line_rule(documents(spark, [None, "", "a b a b a b a b a b a b", "é #1\n\n x \né #1\n x "])).collect()}
    assert rows[0]["n_words"] == 0 and rows[0]["base_failed"] and not rows[0]["kept"]
    assert rows[2]["n_repeat_words"] == 12 and rows[3]["n_dup_lines"] == 2 and rows[3]["n_symbols"] == 2 and rows[3]["word_chars"] == 8
    common = " ".join(f"w{i}" for i in range(30))
    rest = lambda i: " ".join(f"d{i}x{j}" for j in range(40))
    texts = [common + "\n" + rest(i) for i in range(25)] + [common]
    rows = {r["doc_id"]: r for r in quality_rules.line_rule(documents(spark, texts)).collect()}
    assert all(rows[i]["kept"] and rows[i]["n_removed_words"] == 30 for i in range(25)) and not rows[25]["kept"]


def test_line_limit_follows_the_host(spark):
    rest = lambda h, i: " ".join(f"{h}{i}x{j}" for j in range(30))
    rows = []
    for h, n in (("small", 50), ("large", 1000)):
        for i in range(n):
            often, seldom = "a line often seen\n" if i % 10 == 0 else "", "a line seldom seen\n" if i % 50 == 1 else ""
            rows.append((len(rows), often + seldom + rest(h, i), "en", h, 0))
    df = spark.createDataFrame(rows, DOCS)
    out = quality_rules.line_rule(df, percent=4, min_documents=4).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("n_removed_words")).collect()
    assert dict(map(tuple, out)) == {"small": 5 * 4, "large": 100 * 4}
    few = df.filter("source = 'small'").limit(9)
    assert quality_rules.line_rule(few, percent=4, min_documents=9).filter("n_removed_words > 0").count() == 0


def test_line_share_sql(spark):
    sf = SF.replace("0.001", "0.01")
    df = queries.op1_line_share(spark, sf)
    assert df.filter("n_removed_words > 0").count() > 0
    assert_same(df, connected(sf).sql(oracles.LINE_SHARE))


def test_remaining_text(spark):
    rest = " ".join(f"x{j}" for j in range(30))
    common = ["Share  this PAGE", f" share this page \n\n{rest}\nsecond\n", None, "", "share this page", f"{rest}\nshare this\tpage"]
    df = documents(spark, [f"share this page\na{i} {rest}" for i in range(25)]).union(spark.createDataFrame([(100 + i, t, "en", "s", 0) for i, t in enumerate(common)], DOCS))
    out = {r["doc_id"]: r for r in quality_rules.line_rule(df, also=("remaining_text",)).collect()}
    assert [out[100 + i]["remaining_text"] for i in range(6)] == ["", f"\n{rest}\nsecond\n", None, "", "", rest]
    assert [out[100 + i]["n_removed_words"] for i in range(6)] == [3, 3, 0, 0, 3, 3] and all(out[i]["remaining_text"] == f"a{i} {rest}" for i in range(25))
    assert out[101]["kept"] and not out[104]["kept"]


def test_remaining_text_sql(spark):
    sf = SF.replace("0.001", "0.01")
    df = queries.op1_remaining_text(spark, sf)
    assert df.filter("n_removed_words > 0").count() > 0
    assert_same(df, connected(sf).sql(oracles.REMAINING))


def shingles(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def test_minhash_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "One", "one", "one two", "Ünï one two three"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += texts[-3:]
    sets = [shingles(t, 4) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find(range(len(sets)), links)
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, texts), width=4).collect()}
    assert {i: r["component_id"] for i, r in rows.items()} == want
    assert all(rows[i]["n_shingles"] == len(s) and rows[i]["kept"] == (want[i] == i) for i, s in enumerate(sets))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7, 7)]
    want = union_find({x for p in links for x in p}, links)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == c for i, c in want.items())


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [base[i % 60] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.15]) for i in range(400)]
    data = [(i, [float(x) for x in v], 0) for i, v in enumerate(rows)]
    data += [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [None] + [1.0] * 15, 0), (404, [float("nan")] + [1.0] * 15, 0), (405, [float("inf")] + [1.0] * 15, 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in embed_lsh.near_duplicates(df, block=64).collect()}
    x = np.stack(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    near = (cos >= 0.9) & ~np.eye(len(x), dtype=bool)
    found = sum(got[i]["n_links"] for i in range(400))
    assert found >= 0.98 * near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(400))
    want = union_find(range(400), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    assert sum(got[i]["component_id"] == want[i] for i in range(400)) >= 396
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(400, 406))
    assert got[407]["component_id"] == 406 and got[406]["n_links"] == 1


def test_classifier(spark):
    docs, labels = (queries.table(spark, SF.replace("0.001", "0.01"), t) for t in ("documents", "labels"))
    out = queries.op4_quality_classifier(spark, SF.replace("0.001", "0.01"))
    held = out.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held) > 0
    assert out.count() == docs.count()
    one = classifier.train(docs, labels.filter("quality = 1"))
    assert classifier.score(documents(spark, [None, "", "x"]), one).filter("score > 0.9").count() == 3


def test_line_dedup(spark):
    texts = ["a\nb\nc\nd", "x\na\n b \nc\nd\ny", None, "", "a\nb", "q\nq\nq\nq\nq", "\n\n\n\n", "a\nb\nc\nz\nb\nc\nd"]
    rows = {r["doc_id"]: r for r in line_dedup.dedup(documents(spark, texts)).collect()}
    assert rows[0]["text"] == texts[0] and rows[1]["text"] == "x\ny" and rows[1]["n_removed"] == 4 and rows[1]["n_spans"] == 1
    assert rows[2]["text"] is None and rows[2]["n_lines"] == 0 and rows[3]["text"] == "" and rows[4]["text"] == "a\nb"
    assert rows[5]["text"] == "q" and rows[5]["n_removed"] == 4
    assert rows[6]["text"] == texts[6] and rows[7]["text"] == "z" and rows[7]["n_spans"] == 2


def removed(rows, length=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in sorted(data):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd e") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    rows = []
    for i in range(300):
        text = ""
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(base)
            start = rng.randint(0, max(0, len(part) - 1))
            text += part[start : start + rng.randint(1, 250)] + ("é" if rng.random() < 0.3 else "")
        text = "a" * rng.randint(0, 300) if rng.random() < 0.05 else "ab " * rng.randint(0, 100) if rng.random() < 0.05 else text
        rows.append((7 * i - 50, None if rng.random() < 0.02 else text))
    df = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    out = df.select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == removed(rows)


def shared_passage(n):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop ") for _ in range(k))
    passage = word(300)
    return [(i, word(rng.randint(60, 90)) + passage + word(rng.randint(60, 90))) for i in range(n)]


@pytest.mark.parametrize("hot, contexts", [(0, 512), (3, 512), (100, 512), (100, 1), (100, 2)])
def test_suffix_dedup_of_a_frequent_gram(spark, hot, contexts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 2)
    rows = [*shared_passage(80), *((100 + i, t) for i, t in shared_passage(5)), (200, None), (201, "aa" * 90)]
    df = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=hot, frequent_contexts=contexts)
    out = df.select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == removed(rows)


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HASHED_BYTES", 300)  # by value, so tasks see it
    rng = random.Random(11)
    base = "".join(rng.choice("abcdef ") for _ in range(4000))
    rows = [(1, base), (2, base[700:2500] + "x" + base[100:3000]), (3, "ab" * 900), (4, "ba" * 700), (5, base[1:]), (6, "q" + base[:1000])]
    df = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=0)
    out = df.select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == removed(rows)
    data = np.frombuffer(base.encode(), np.uint8)
    assert len(suffix_dedup.covers(data, np.array([0, len(data)]), 50, 20)[0]) > len(suffix_dedup._covers(data, np.array([0, len(data)]), 50, 20)[0])


def test_suffix_dedup_spreads_a_frequent_gram():
    import pyarrow as pa

    buckets = 16
    rows = shared_passage(6000)
    docs = pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "sub": pa.array([0] * len(rows), pa.int64())})
    first = [x for b in suffix_dedup._first_step(buckets, 1, 50, 20, 1 << 16)(iter(docs.to_batches(max_chunksize=100))) for x in b.to_pylist()]
    first = sorted(first, key=lambda r: (r["kind"], r["part"]))
    batch = pa.RecordBatch.from_pylist(first, pa.schema(list(zip(suffix_dedup._NAMES, suffix_dedup._KINDS, strict=True))))
    marks = pa.Table.from_batches(list(suffix_dedup._first_buckets(1, 256)(iter([batch]))))
    marks = marks.filter(pa.compute.equal(marks["kind"], 1))
    most = Counter()
    for r in suffix_dedup._second_step(buckets, 1, 50, 20)(docs, marks).to_pylist():
        if r["kind"] == 0:
            most[0, r["part"]] += int(np.frombuffer(r["a"], np.uint8).astype(int).sum()) + len(r["a"])
        if r["kind"] == 2:
            most[2, r["part"]] += len(r["a"])
    assert sum(most.values()) > 20_000 and max(most.values()) < 0.2 * sum(most.values())


@pytest.mark.parametrize("hot", [0, 4096])
def test_suffix_dedup_of_hot_ids_against_brute_force(spark, monkeypatch, hot):
    """A third without id, a third with one id: each row by its own text, and in many groups."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 2000)
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 140))) for _ in range(12)]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("uvwxyz ") for _ in range(40)) for _ in range(4))
        rows += [(None if i % 3 == 0 else 40 if i % 3 == 1 else i, text)] * (3 if i % 10 == 0 else 1)
    first = {}
    last = (1 << 63) - 1
    for i, t in rows:
        for p in range(len(t) - 49):
            k = t[p : p + 50]
            first[k] = min(first.get(k, last), last if i is None else i)
    want = []
    for i, t in rows:
        gone = set()
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < (last if i is None else i):
                gone.update(range(p, p + 50))
        want.append((i or -1, "".join(c for j, c in enumerate(t) if j not in gone)))
    out = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=hot).select("doc_id", F.col("kept").cast("string").alias("kept")).collect()
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in out) == sorted(want)
    assert sum(len(t) for _, t in want) < 0.9 * sum(len(t) for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = suffix_dedup._prime(17)
    name = df.select(F.coalesce("doc_id", F.lit(last)).alias("i"), F.xxhash64("text").bitwiseAND(0xFFFFFFFF).alias("s")).collect()
    most = Counter(int(suffix_dedup._group(np.array([r["i"]]), suffix_dedup._places(r["s"], np.array([0])), groups)[0]) for r in name)
    assert len(most) == groups and max(most.values()) < 0.2 * len(rows)


def test_suffix_dedup_null_and_repeated_ids(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, "x" + text), (2, "short")], "doc_id long, text string")
    rows = suffix_dedup.dedup(df).select("doc_id", F.octet_length("kept").alias("n")).collect()
    assert sorted((r["doc_id"] or 99, r["n"]) for r in rows) == [(1, len(text)), (1, len(text)), (2, 5), (99, 1)]


def test_language(spark):
    sf = SF.replace("0.001", "0.01")
    out = queries.op7_language_id(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    docs = queries.table(spark, sf, "documents")
    model = langid.train(docs.filter("doc_id < 300"))
    rows = {r["doc_id"]: r for r in langid.predict(documents(spark, [None, "", "12 !?", "the and of is"]), model).collect()}
    assert [rows[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and rows[0]["score"] == 0 and rows[3]["lang_pred"] != "und"


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy this and that now</div><div id="cookie-notice">We use cookies</div>
<article class="post"><header><h1>A &amp; B</h1></header><p>First<b> bold</b>   text <br>line.<p>Next&nbsp;one<form><input>Mail</form>
<aside>Related</aside><div class="comments"><p>Nice!</p></div><p>Short.</p></article><footer>&copy; x</footer></body></html>"""


def test_html():
    assert html.main_text(PAGE) == "A & B First bold text line. Next one Short."
    long = "The house on the hill is as old as the town and was built by the people who had come from the coast."
    plain = f"<body><ul><li><a href=x>one</a></li></ul><p>{long}</p><p>Short one.</p><p>{long}</p><p><a href=y>link link link</a></p></body>"
    assert html.main_text(plain) == f"{long} Short one. {long}"


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), "en", rng.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(400)]
    rows += [(400, None, "en", "e", 0), (401, "one two", "en", "tiny", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, shard_words=500).collect()
    assert len(got) == 402 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    per = {r["source"]: r for r in got}
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    total = sum(r["size"] for r in got)
    assert abs(sum(r["target"] for r in per.values()) - total) < 1e-6 * total
    shards = {s: max(1, r["source_size"] / 500 + 1) for s, r in per.items()}
    assert all(r["target"] - 16 * (shards[s] + 2) <= taken[s] <= r["target"] + 32 for s, r in per.items())
    assert per["tiny"]["target"] == 6 and per["e"]["target"] == 0
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7), shard_words=500).collect()), key=str)
    copies = mixing.apply_mix(df).groupBy("doc_id").count().collect()
    assert all(r["count"] <= 3 for r in copies)


def test_sainte_lague(spark):
    votes = {"a": 53_000, "b": 24_000, "c": 23_000, "d": 1, "e": 0}
    for seats in (0, 1, 7, 100, 1001):
        df = spark.createDataFrame([("g", k, v, seats) for k, v in votes.items()], "g string, p string, v long, n long")
        got = {r["p"]: r["quota"] for r in mixing.sainte_lague(df, ["g"], "p", "v", "n").collect()}
        best = sorted(((-v / (2 * j + 1), k) for k, v in votes.items() if v for j in range(seats)))[:seats]
        assert got == {k: sum(1 for _, x in best if x == k) for k in votes}


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    plain = Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = ["a", "b", "The", " ", "\n", "\t", "é", "'s", ",", "1", "!!", "<|endoftext|>", "日本", "  ", "\r\n", ".", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    encoder = packing.TextEncoder(path)
    texts += [" " * 5000 + "x", "a" * 3000, "\n" * 2500, *(" ".join(rng.choice(parts) for _ in range(4000)) for _ in range(3))]
    texts += ["".join(f"a{chr(c)}1{chr(c)}! {chr(c)}b" for c in range(at, at + 0x1000) if not 0xD800 <= c < 0xE000) for at in range(0, 0x30000, 0x1000)]
    assert encoder.ranked is not None
    for window in (packing.WINDOW, 50):
        packing.WINDOW, before = window, packing.WINDOW
        assert all(np.frombuffer(encoder.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids for t in texts)
        packing.WINDOW = before
    encoder.ranked = None  # as for a file of another kind
    assert all(np.frombuffer(encoder.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids for t in texts[:50])
    docs = [None, "", "x" * 9000, *(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 700))) for _ in range(120))]
    pieces = packing.cut(documents(spark, docs), path, 128)
    rows = packing.pack(pieces, 128, group_pieces=40, open_bins=8).collect()
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= 128
    by_doc: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        got = by_doc.setdefault(r["doc_id"], [])
        assert r["start"] == len(got) and r["length"] * 4 == len(r["ids"]) and (r["length"] == 128 or r["piece"] == 0)
        got.extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert all(by_doc[i] == [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(docs))
    total = sum(map(len, by_doc.values()))
    assert len(bins) <= 1.15 * total / 128 + 4


@pytest.mark.parametrize("most", [1, 3, 50])
def test_bins_against_plain_lists(most):
    rng = random.Random(most)
    bins, opened, free = packing.Bins(64, most), 0, []  # free: (space, last change, number)
    for step in range(3000):
        size = rng.randint(1, 63)
        fit = min(((f, -t, b) for f, t, b in free if f >= size), default=None)
        if fit:
            space, t, b = fit
            free.remove((space, -t, b))
        else:
            space, b, opened = 64, opened, opened + 1
        if space > size:
            free.append((space - size, step, b))
            if len(free) > most:
                f, t, out = min((f, -t, b) for f, t, b in free)
                free.remove((f, -t, out))
        assert bins.place(size) == (b, 64 - space)


def test_held_out_flags(spark):
    rows = queries.op7_language_id(spark, SF).select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def plainly_accepted(rows):
    """Ids that the language stage keeps, by plain counting of byte n-grams."""
    from tests.llm.test_defined_cases import grams

    own = {i: Counter(grams(r["text"] or "", langid.ORDERS, langid.BITS, True)) for i, r in rows.items()}
    learn = [i for i in rows if zlib.crc32(str(i).encode()) % 3 != 1 and rows[i]["lang"] and rows[i]["text"] is not None]
    texts = Counter(rows[i]["lang"] for i in learn)
    counts: dict = {lang: Counter() for lang in texts}
    for i in learn:
        counts[rows[i]["lang"]].update(own[i])
    kept = set()
    for i, r in rows.items():
        if not any(c.isalpha() for c in r["text"] or ""):
            continue
        z = {}
        for lang, seen in counts.items():
            total = np.log(sum(seen.values()) + 0.1 * 65536)
            z[lang] = np.log(texts[lang] / sum(texts.values())) + sum(n * (np.log(seen[g] + 0.1) - total) for g, n in own[i].items())
        best = max(z.values())
        if 1 / sum(np.exp(v - best) for v in z.values()) >= 0.5:
            kept.add(i)
    return kept


def test_pipeline(spark):
    """Each stage on what the one before leaves: plain counting, the SQL of its operator, or plain sets."""
    import duckdb

    import corpus_pipeline
    from rivulet.llm.common import stored

    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, SF))
        assert after.columns == columns and after.count() > 0
        con = duckdb.connect()
        con.register("documents", before.toPandas())
        sql = lambda q: con.sql(q).fetchall()  # noqa: E731, B023
        if name == "language_id":
            assert {r["doc_id"] for r in after.collect()} == plainly_accepted({r["doc_id"]: r for r in before.collect()})
        if name == "line_dedup":
            want = dict(sql(f"SELECT doc_id, kept_md5 FROM ({oracles.LINE_DEDUP})"))
            assert {r["doc_id"]: hashlib.md5(r["text"].encode()).hexdigest() for r in after.collect()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        if name == "near_dedup":
            sets = {r["doc_id"]: shingles(r["text"], 5) for r in before.collect()}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            root = union_find(sets, links)
            assert {r["doc_id"] for r in after.collect()} == {i for i in sets if root[i] == i}
        if name == "source_mixing":
            want = {i: int(taken / size + 0.5) for i, size, taken in sql(f"SELECT doc_id, size, taken FROM ({oracles.MIXING})") if size}
            assert Counter(r["doc_id"] for r in after.collect()) == {i: n for i, n in want.items() if n}
        before = after
    rows = before.collect()
    check_packing(corpus_pipeline.STAGES[-1][1](spark, before, SF).collect(), [(r["doc_id"], r["text"]) for r in rows])


def check_packing(pieces, docs, length=1024):
    """Whole texts in order, gapless sequences, and nearly as few of them as can be."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = Counter()
    for key, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        at, piece = 0, 0
        while at < len(ids):
            size = (len(ids) - at) % length or length
            want[key, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at, piece = at + size, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    sequences: dict = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= length
    # all pieces at hand at once, the long ones first, each into the fullest bin that takes it
    free: list[int] = []
    for size in sorted((k[3] for k, n in want.items() for _ in range(n)), reverse=True):
        fits = [f for f in free if f >= size]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else length) - size)
    assert len(sequences) <= 1.02 * len(free) + 1


def test_packing_query(spark):
    docs = queries.table(spark, SF, "documents").collect()
    check_packing(queries.op10_best_fit_packing(spark, SF).collect(), [(r["doc_id"], r["text"]) for r in docs])
