"""Every text operator and pipeline stage on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rivulet.llm import classifier, common, embed_lsh, html, langid, line_dedup, minhash, mixing, packing, quality_rules, queries, suffix_dedup
from rivulet.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = "n_words kept base_failed id t n h1 h2 k key rep component_id n_lines n_removed n_spans starts __starts lang_pred score lettered __lettered size taken times __times __copy piece start length ids sequence_id offset __order remaining_text n_left_words gone host part word".split()


def model():
    rng = np.random.default_rng(1)
    size = 1 << langid.BITS
    return langid.Model(["de", "en"], np.log([0.5, 0.5]), np.zeros(2, np.float32), np.array([0, size, 2 * size]), np.tile(np.arange(size, dtype=np.int32), 2), np.log(rng.uniform(0.1, 1, 2 * size)).astype(np.float32))


def quality():
    return classifier.Model(np.random.default_rng(2).standard_normal(1 << classifier.BITS).astype(np.float32), 0.1)


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path(queries.TOKENIZER)


OPERATORS = {
    "op1": quality_rules.line_rule,
    "op1_text": quality_rules.without_boilerplate,
    "op2": minhash.near_duplicates,
    "op2_drop": minhash.drop_duplicates,
    "op4": lambda d: classifier.score(d, quality()),
    "op5": line_dedup.dedup,
    "op6": suffix_dedup.dedup,
    "op7": lambda d: langid.predict(d, model()),
    "op8": lambda d: html.extract(d, html="text", text="main"),
    "op9": mixing.mix,
    "op9_apply": mixing.apply_mix,
    "op10": lambda d: packing.pack(packing.cut(d, tokenizer()).withColumn("crc", F.crc32("ids")).drop("ids")),
}
#: Those that return one row for each row.
EACH = [n for n in OPERATORS if n not in ("op2_drop", "op9_apply", "op10")]
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(spark, data, more=""):
    return spark.createDataFrame(data, DOCS + more).repartition(3)


def cases():
    long = "the quick brown fox and its friend " * 3000
    return [(1, None, None, None, None), (None, "null key text of a document", "en", "a", 3), (None, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", None, "", 3), (4, long, "en", "a", 9), (5, long, "en", "b", 9), (6, "one", "en", None, 3), (6, "one", "en", None, 3), (7, "two\nlines", "de", "a", 1)]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nulls_long_texts_and_repeated_rows(spark, name):
    df = rows_of(spark, cases())
    out = OPERATORS[name](df).collect()
    if name in EACH:
        assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in cases())
    same = [r for r in out if r["doc_id"] == 6]
    if name in ("op1", "op1_text", "op2", "op4", "op5", "op6", "op7", "op8"):
        assert same[0] == same[1]
    flags = [c for c, t in OPERATORS[name](df.limit(0)).dtypes if t == "boolean"]
    assert all(r[c] is not None for r in out for c in flags)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](rows_of(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(spark, name):
    df = rows_of(spark, cases())
    names = [c for c in CLASHING if c not in ("doc_id", "text")]
    wide = df.select("*", *[F.lit("old").alias(c) for c in names])
    plain = [c for c in OPERATORS[name](df).columns if c not in ("sequence_id", "offset")]  # numbers of sequences are free
    key = lambda rows: sorted(map(str, (tuple(r[c] for c in plain) for r in rows)))
    out = OPERATORS[name](wide)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert key(out.collect()) == key(OPERATORS[name](df).collect())
    if name in ("op1_text", "op2_drop", "op5", "op7", "op8", "op9_apply"):
        added = set(plain) - set(df.columns)
        assert out.select(*[c for c in names if c not in added]).distinct().count() <= 1


@pytest.mark.parametrize("name", sorted(STAGES))
def test_pipeline_stages(spark, name, tmp_path):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    odd = docs.unionByName(rows_of(spark, cases()).select([F.col(c).cast(t) for c, t in docs.dtypes]))
    wide = odd.select("*", *[F.lit("old").alias(c) for c in CLASHING])
    out = STAGES[name](spark, wide, "")
    if name == "packing":
        assert out.count() >= wide.count()
        return
    assert out.columns == wide.columns
    rows = out.collect()
    assert all(r[c] == "old" for r in rows for c in CLASHING) and rows
    per = Counter(r["doc_id"] for r in rows)
    if name == "language_id":
        assert not {1, 2, 3} & {r["doc_id"] for r in rows if r["source"] in (None, "", "a") and not (r["text"] or "").strip()}
    if name == "near_dedup":
        assert max(n for k, n in per.items() if k is not None) == 1 and per[None] == 2
    if name == "line_dedup":
        assert len(rows) == wide.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    queries.table(spark, "/root/testdata/sf0.001", "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_embeddings(spark):
    v = [1.0, 0.5, 0.25]
    data = [(3, v, "x"), (3, v, "x"), (2, [2 * x for x in v], "x"), (1, None, "x"), (None, v, "x"), (5, [-0.0, 1.0, 0.0], "x"), (6, [0.0, 1.0, -0.0], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n string").select("*", *[F.lit("old").alias(c) for c in ("rep", "id", "vec", "links", "table", "size")])
    out = sorted(map(tuple, embed_lsh.near_duplicates(df).collect()), key=str)
    assert out == sorted([(3, 2, 2, False), (3, 2, 2, False), (2, 2, 2, True), (1, 0, 1, True), (None, 0, None, True), (5, 1, 5, True), (6, 1, 5, False)], key=str)


def test_repeated_ids_with_different_texts(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    data = [(5, words("w", 30), "", "s", 0), (5, words("v", 40), "", "s", 0), (6, words("v", 40), "", "s", 0), (7, words("w", 30), "", "s", 0)]
    df = rows_of(spark, data)
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(5, 5), (5, 5), (6, 6), (7, 5)]  # the smaller set stands for 5
    assert sorted((r["doc_id"], r["text"][0]) for r in minhash.drop_duplicates(df).collect()) == [(5, "w"), (6, "v")]


def test_null_and_empty_hosts_are_apart(spark):
    line = "the same line of several words in each"
    body = lambda i: line + "\n" + " ".join(f"d{i}x{j}" for j in range(30))
    df = rows_of(spark, [(i, body(i), "en", None if i % 2 else "", 0) for i in range(30)])
    assert quality_rules.line_rule(df).filter("n_removed_words > 0").count() == 0
    assert quality_rules.line_rule(df, max_documents=14).filter("n_removed_words > 0").count() == 30
    assert quality_rules.line_rule(df, max_documents=15).filter("n_removed_words > 0").count() == 0  # at the limit


def test_mix_takes_null_keys_and_repeated_ids(spark):
    data = [(None, "a b c d e f g h", "en", "s", 0), (None, "i j k l m n o p", "en", "s", 0), (1, "x " * 16, "en", "s", 0), (1, "y " * 80, "en", "s", 0), (2, None, "en", "s", 0)]
    df = rows_of(spark, data)
    got = {(r["doc_id"], r["text"]): r["n"] for r in mixing.apply_mix(df).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(r[0], r[1]): 1 for r in data if r[1]}


def test_hot_keys_are_joined_where_they_are(spark, monkeypatch):
    """The same results when nearly every key counts as hot."""
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(60)) for _ in range(6)]
    texts = [rng.choice(base) + ("" if rng.random() < 0.5 else f" x{i}") + "\nline one\nline two\nline three" for i in range(120)]
    df = rows_of(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    links = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(40 + i % 3, 43 + i) for i in range(30)], "a long, b long")
    runs = {
        "minhash": lambda: minhash.near_duplicates(df),
        "lines": lambda: line_dedup.dedup(df),
        "rules": lambda: quality_rules.line_rule(df, max_documents=5),
        "graph": lambda: components(links),
    }
    before = {k: sorted(map(str, f().collect())) for k, f in runs.items()}
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(common, "HOT_KEYS", 1000)
    assert {k: sorted(map(str, f().collect())) for k, f in runs.items()} == before


def test_scratch_is_cleared_and_never_local_on_a_cluster(spark, tmp_path, monkeypatch):
    own, folder = common.scratch, str(tmp_path / "scratch")
    monkeypatch.setattr(common, "scratch", lambda spark: folder)
    with common.cleared(spark):
        assert common.stored(spark.range(3)).count() == 3
        assert len(list(tmp_path.rglob("*.parquet"))) > 0
    assert list(tmp_path.rglob("*.parquet")) == []

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://head:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        own(Cluster)


def fnv(data: bytes, n: int, bits: int) -> int:
    x = (0x811C9DC5 + n) & 0xFFFFFFFF
    for b in data:
        x = ((x ^ b) * 0x01000193) & 0xFFFFFFFF
    x ^= x >> 15
    return ((x * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits)


def grams(text: str, orders, bits: int, lower: bool) -> list[int]:
    data = text.encode()
    data = bytes(b + 32 if lower and 65 <= b <= 90 else b for b in data)
    return [fnv(data[i : i + n], n, bits) for n in orders for i in range(len(data) - n + 1)]


TEXTS = ["Über den Fluss", "The river runs", "a", "", "der die das und der", "of the and the of"]


def test_language_against_a_plain_version(spark, monkeypatch):
    data = [(i, t, "de" if i % 2 == 0 else "en", "s", 0) for i, t in enumerate(TEXTS)]
    for size in (common.PIECE_BYTES, 4):  # the second takes every text in runs
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        monkeypatch.setattr(common.pieces, "__defaults__", (size,))
        got = langid.train(rows_of(spark, data), alpha=0.5)
        counts = {k: Counter(g for _, t, lang, *_ in data if lang == k for g in grams(t, langid.ORDERS, langid.BITS, True)) for k in ("de", "en")}
        assert got.langs == ["de", "en"]
        for k, lang in enumerate(got.langs):
            total = sum(counts[lang].values()) + 0.5 * 65536
            want = np.log((np.array([counts[lang].get(b, 0) for b in range(65536)]) + 0.5) / total)
            assert np.allclose(got.dense(k, k + 1)[0], want, atol=1e-5) and np.isclose(got.prior[k], np.log(0.5))
        logp = got.dense(0, 2)
        z = langid.log_odds(got.prior, logp, pa.array(TEXTS))
        for row, text in zip(z, TEXTS, strict=True):
            want = [got.prior[k] + sum(float(logp[k][g]) for g in grams(text, langid.ORDERS, langid.BITS, True)) for k in range(2)]
            assert np.allclose(row, want, atol=1e-3)


def test_few_texts_of_a_language_are_learned(spark):
    """However many languages and rows there are, and in blocks of languages as in one."""
    odd = "zzyzx qwrtp vlkshn"
    data = [(i, f"some text here {i}", "en", "s", 0) for i in range(3000)] + [(5000 + i, odd, "xx", "s", 0) for i in range(5)]
    data += [(6000 + i, f"{chr(0x4E00 + i) * 9} dirty", f"d{i:02d}", "s", 0) for i in range(40)]
    got = langid.train(rows_of(spark, data))
    assert got.langs == sorted({r[2] for r in data})
    found = {r["doc_id"]: r for r in langid.predict(rows_of(spark, data), got).collect()}
    assert all(found[r[0]]["lang_pred"] == r[2] and found[r[0]]["score"] > 0.5 for r in data)
    texts = pa.array([r[1] for r in data[-60:]])
    z = langid.log_odds(got.prior, got.dense(0, len(got.langs)), texts)
    best, score = langid.judged(got, None, texts)
    assert best.tolist() == z.argmax(axis=1).tolist() and np.allclose(score, 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))


def bounded(spark, data, rows):
    df = rows_of(spark, data)
    slim = df.select("lang", F.xxhash64("text").alias("h"))
    return {(r["lang"], r["text"]): r["times"] for r in common.bounded_texts(slim, df, "text", "lang", rows).collect()}


def test_fitted_texts_are_bounded_whatever_the_ids(spark):
    texts = [(f"text number {i}", "de" if i % 3 else "en") for i in range(4000)]
    own = bounded(spark, [(i, t, k, "s", 0) for i, (t, k) in enumerate(texts)], 1000)
    assert own == bounded(spark, [(None, t, k, "s", 0) for t, k in texts], 1000) == bounded(spark, [(7 if i % 2 else i, t, k, "s", 0) for i, (t, k) in enumerate(texts)], 1000)
    assert 850 < sum(own.values()) <= 1000 and 250 < sum(n for (k, _), n in own.items() if k == "en") < 420
    # a third of the rows are one text: it gets a third
    hot = bounded(spark, [(1, "the same", "de", "s", 0)] * 2000 + [(i, t, k, "s", 0) for i, (t, k) in enumerate(texts)], 900)
    assert 299 <= hot["de", "the same"] <= 301 and 750 < sum(hot.values()) <= 900
    few = bounded(spark, [(1, "x", "de", "s", 0)] * 3 + [(2, "x", "en", "s", 0), (3, "y", "en", "s", 0)], 5)
    assert few == {("de", "x"): 3, ("en", "x"): 1, ("en", "y"): 1}


def test_languages_are_learned_from_null_and_repeated_ids(spark):
    data = [("the river runs and the wood is of oak", "en"), ("der Fluss und die Stadt sind das", "de")]
    rows = lambda key: [(key(i), f"{data[i % 2][0]} {i}", data[i % 2][1], "s", 0) for i in range(600)]
    models = [langid.train(rows_of(spark, rows(key)), fit_rows=200) for key in (lambda i: i, lambda i: None, lambda i: 7)]
    for m in models[1:]:
        assert m.langs == ["de", "en"] and all(np.array_equal(a, b) for a, b in zip(m.parts()[1:], models[0].parts()[1:], strict=True))


def test_quality_is_learned_from_a_bounded_number_of_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "fit", lambda bags: seen.append(len(bags)))
    docs = rows_of(spark, [(1, f"text {i}", "en", "s", 0) for i in range(3000)] + [(2 + i, "a text", "en", "s", 0) for i in range(50)] + [(None, "no id", "en", "s", 0)])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    for most in (100, 10_000):
        classifier.train(docs, labels, fit_rows=most)
    assert 60 < seen[0] <= 100 and seen[1] == 3001


def test_fit_against_a_plain_descent():
    rng = np.random.default_rng(4)
    bags = []
    for i in range(21):
        at = np.sort(rng.choice(40, 6, replace=False)).astype(np.uint16)
        share = rng.uniform(0.1, 1, 6)
        bags.append((int(i % 3 == 0), at, (share / share.sum()).astype(np.float32)))
    epochs, rate, batch, seed, d = 3, 60.0, 4, 1, classifier.DIM
    got = classifier.fit(bags, epochs=epochs, rate=rate, batch=batch, seed=seed)
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / d, 1 / d, (1 << classifier.BITS, d)).astype(np.float32).astype(float)
    layer = draw.uniform(-1, 1, (d, 2)).astype(np.float32).astype(float)
    ones = sum(b[0] for b in bags)
    bias = [float(np.log((len(bags) - ones) / len(bags))), float(np.log(ones / len(bags)))]
    step, steps = 0, epochs * 6
    for _ in range(epochs):
        order = draw.permutation(len(bags))
        for i in range(0, len(order), batch):
            rows = [bags[r] for r in order[i : i + batch]]
            now = rate * (1 - step / steps)
            dv, dl, db = {}, np.zeros((d, 2)), np.zeros(2)
            for label, at, share in rows:  # the gradient of one text after another
                hidden = [sum(float(s) * vectors[a][k] for a, s in zip(at, share, strict=True)) for k in range(d)]
                z = [sum(hidden[k] * layer[k][c] for k in range(d)) + bias[c] for c in range(2)]
                p = [float(np.exp(x - max(z))) for x in z]
                err = [(x / sum(p) - (c == label)) / len(rows) for c, x in enumerate(p)]
                db += err
                for k in range(d):
                    for c in range(2):
                        dl[k, c] += hidden[k] * err[c]
                    for a, s in zip(at, share, strict=True):
                        dv[int(a), k] = dv.get((int(a), k), 0.0) + float(s) * sum(layer[k][c] * err[c] for c in range(2))
            layer = layer - now / 60 * dl
            bias = [bias[c] - now / 600 * db[c] for c in range(2)]
            for (a, k), g in dv.items():
                vectors[a, k] -= now * g
            step += 1
    out = layer[:, 1] - layer[:, 0]
    assert np.allclose(got.weight, vectors @ out, atol=2e-4) and np.isclose(got.bias, bias[1] - bias[0], atol=1e-4)


def test_classifier_against_a_plain_version(monkeypatch):
    model, words = quality(), re.compile(r"[^\x20\x09-\x0D]+")
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & mask
        x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & mask
        return x ^ (x >> 33)

    def word(w):
        power, total = 1, 0
        for b in w.encode():
            # the table of powers starts with the base itself
            power = power * 0x9E3779B97F4A7C15 & mask
            total = (total + (b + 1) * power) & mask
        return mix(total)

    for size in (common.PIECE_BYTES, 8):
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        monkeypatch.setattr(common.pieces, "__defaults__", (size,))
        monkeypatch.setattr(common.split_words, "__defaults__", (size,))
        got = classifier.scores(model, pa.array(TEXTS))
        for text, score in zip(TEXTS, got, strict=True):
            own = [word(w) for w in words.findall(text)]
            features = grams(text, classifier.GRAMS, classifier.BITS, False)
            features += [w >> (64 - classifier.BITS) for w in own]
            features += [mix(a ^ b ^ 0x9E3779B97F4A7C15) >> (64 - classifier.BITS) for a, b in zip(own, own[1:], strict=False)]
            z = model.bias + (sum(float(model.weight[f]) for f in features) / len(features) if features else 0)
            assert np.isclose(score, 1 / (1 + np.exp(-z)), atol=1e-5)


def hot_rows(spark, n=3000):
    """A third with null ids, a third with one id, some rows of them alike."""
    data = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"words of text {i % 500 if i % 2 else i} and more", "en", "s", 0) for i in range(n)]
    return data, rows_of(spark, data)


def test_hot_keys_spread_over_groups_and_shards(spark):
    data, df = hot_rows(spark)
    packed = packing.pack(packing.cut(df, tokenizer()).withColumn("crc", F.crc32("ids")).drop("ids"), group_pieces=300)
    per = {r["g"]: r["n"] for r in packed.groupBy(F.shiftright("sequence_id", 33).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(per) == 10 and max(per.values()) < 500 and sum(per.values()) == len(data)
    shards = mixing._mixed(df, mixing.WEIGHTS, 3, 16, 1000, 1, "text", "doc_id", "source").filter("before = 0").count()
    assert shards > 10  # each has one first row
    mixed = mixing.mix(df, shard_words=1000).collect()
    assert Counter((r["doc_id"], r["size"]) for r in mixed) == Counter((r[0], len(r[1].split())) for r in data)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed) and abs(sum(r["taken"] for r in mixed) - mixed[0]["target"]) < 16 * 20


def test_copies_of_a_document_are_taken_one_after_another(spark):
    df = rows_of(spark, [(None, "a b c d", "en", "s", 0)] * 25 + [(1, "e f", "en", "t", 0)])
    whole = sorted(r["taken"] for r in mixing.mix(df, weights=(1, 1), block=2).collect() if r["doc_id"] is None)
    assert sum(whole) == 96 and whole == [0] + [4] * 24  # the other source gives 6 at most
    rows = mixing._mixed(df, (1, 1), 3, 2, 1000, 1, "text", "doc_id", "source")
    assert mixing._copies(rows, most=4).select("copy").filter("k is null").count() == 25
