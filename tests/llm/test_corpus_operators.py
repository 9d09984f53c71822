"""The corpus operators against brute force, library results, round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import rows_of, table_views
from pyspark.sql import functions as F

from fascicle.llm import bestfit_pack, bpe_prefix, chat_format, embed_pstable, langid_bloom, license_join, quality_cascade, simhash_similar, simhash_vptree, toxicity_nbsvm, url_reputation
from fascicle.llm import queries as q
from fascicle.llm.common import connected_components, forest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, word string, score string, n_words string"
ODD = [None, "", " \n\t ", "one", "a b c", "Ünï cödé テキスト 😀 [x] </s>", "x" * 50_000, "word " * 30_000, "same text here for all of us", "same text here for all of us", "\0 nul  two  spaces\r\n", "#*$%&|<>" * 40]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null id, and columns whose names operators use themselves."""
    rows = [(k, t, None, None, None, 1, "w", "s", "n") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", "en", "s", 1, 1, "w", "s", "n")], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    table_views(c, sf)
    return c


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_oracle(spark, sf, con, name):
    got, want = q.queries()[name](spark, sf).toPandas(), con.sql(q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_connected_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)]
    want = components(500, edges)
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_simhash(text, size):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, sf, odd, none):
    for docs in (q.read(spark, sf, "documents"), odd):
        rows = [(r["doc_id"], slow_simhash(r["text"], 4)) for r in docs.select("doc_id", "text").collect()]
        comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4])
        first = defaultdict(lambda: 1 << 60)
        for c, (d, _) in zip(comp, rows):
            first[c] = min(first[c], d if d is not None else 1 << 60)
        want = sorted((d is None, d, f"{f:016x}", first[c] if first[c] < 1 << 60 else None) for c, (d, f) in zip(comp, rows))
        got = sorted((r["doc_id"] is None, r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_vptree.simhash_groups(docs).collect())
        assert got == want
    assert simhash_vptree.simhash_groups(none).count() == 0 and simhash_similar.keep_first(none).count() == 0
    kept = simhash_similar.keep_first(odd)
    assert kept.columns == odd.columns and kept.where("text = 'same text here for all of us'").count() == 1


def test_vptree_finds_every_near_pair(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) if k else b for b, k in zip(base, rng.integers(0, 7, 300))]
    tight = [base[0] ^ (np.uint64(x) << np.uint64(20)) for x in range(3000)]
    fp = np.unique(np.concatenate((base, near, tight)).astype(np.uint64))
    links = []
    for i in range(len(fp)):
        links += [(i, int(j)) for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= 4)]
    want = components(len(fp), links)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = [(r["a"], r["b"]) for r in simhash_vptree.fingerprint_links(df).collect()]
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in got)
    assert components(len(fp), [(at[a], at[b]) for a, b in got]) == want
    assert len(got) < 60 * len(fp)
    # Every shard far above the bound: dealt to pairs of parts, the same links come out.
    for split in (4, 100):
        got = [(r["a"], r["b"]) for r in simhash_vptree.fingerprint_links(df, split).collect()]
        assert components(len(fp), [(at[a], at[b]) for a, b in got]) == want
    big = np.unique(np.concatenate((tight, base)).astype(np.uint64))
    close = [(i, int(j)) for i in range(len(big)) for j in np.flatnonzero(np.bitwise_count(big[:i] ^ big[i]) <= 4)]
    at = {int(x): k for k, x in enumerate(big)}
    out = simhash_vptree.shard_links(big, np.ones(len(big), bool))
    assert components(len(big), [(at[int(a)], at[int(b)]) for a, b in zip(*out)]) == components(len(big), close)


def test_trees_prune_by_the_triangle_bound_and_grow_with_the_corpus():
    """Shards meet every pair within one bit of a slice exactly once, and compared pairs stay flat."""
    rng = np.random.default_rng(9)
    for bits in (2, 5, 8, 21):
        x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        y = x.copy()
        flips = rng.integers(-1, 21, len(x))
        y[flips >= 0] ^= np.uint64(1) << flips[flips >= 0].astype(np.uint64)
        rows, shards = simhash_vptree.tree_shards(np.concatenate((x, y)), 0, bits)
        home, of = shards[:800], defaultdict(set)
        for r, s in zip(rows.tolist(), shards.tolist()):
            of[r].add(s)
        for k in range(400):
            meets = (home[k] in of[k + 400]) + (home[k + 400] in of[k]) - (home[k] == home[k + 400])
            assert meets == 1
        assert all(len(v) <= bits + 1 for v in of.values())
    compared = []
    for n in (20_000, 200_000):
        fp = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        rows, shards = simhash_vptree.tree_shards(fp, 1, simhash_vptree.depth(n))
        counts = np.unique(shards, return_counts=True)[1]
        compared.append((counts * counts).sum() / n)
        assert counts.max() < 2000
    assert compared[1] < 2 * compared[0]


def test_toxicity_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    got = q.op2_toxicity(spark, sf).join(q.read(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    # 352 toxic rows in four languages are learned from here; the scale tables reach 0.999.
    assert (got["predicted"] == got["toxic"]).mean() > 0.96
    assert got[got["toxic"] == 1]["predicted"].mean() > 0.75 and got["score"].between(0, 1).all()
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"])
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (8, 0), (8, 0)], "doc_id long, toxic int")
    model = toxicity_nbsvm.fit(odd, labels)
    scored = odd.select(toxicity_nbsvm.score(F.col("text"), model).alias("s")).toPandas()["s"]
    assert len(scored) == odd.count() and scored.between(0, 1).all()
    empty = toxicity_nbsvm.fit(none, labels)
    assert odd.select(toxicity_nbsvm.score(F.col("text"), empty).alias("s")).distinct().count() == 1


def test_language_held_out(spark, sf, odd, none):
    sf1 = "/root/testdata/sf0.01"
    got = q.op4_language(spark, sf1).withColumnRenamed("score", "s").join(q.read(spark, sf1, "documents"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["s"].between(0, 1).all()
    assert all(zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"])
    model = langid_bloom.fit(q.read(spark, sf, "documents"))
    rows = odd.select("text", langid_bloom.predict(F.col("text"), model).alias("p")).collect()
    assert all((r["p"]["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"])) for r in rows)
    assert langid_bloom.fit(none).predict("text") == ("und", 0.0)


def test_bloom_masks_hold_every_language():
    texts, langs = ["abcd efgh"] * 2 + ["abcd wxyz"] * 2, ["p", "q", "r", "s"]
    m = langid_bloom.train(texts, langs)
    h = np.concatenate(list(langid_bloom.gram_hashes("abcd", (3,))))
    assert (m.masks(h)[0][1:3] == 15).all()  # grams inside the word stand in every text
    many = langid_bloom.train([f"{chr(97 + k % 26)}{k} word" for k in range(12)], [f"l{k:02}" for k in range(12)])
    assert many.predict("a0 a0 a0")[0] == "l00"


def slow_grams(text, size):
    low = f" {text.lower()} "
    for k in range(len(low) - size + 1):
        h = 0
        for c in low[k : k + size]:
            h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
        yield h


def test_language_against_brute_force(spark):
    """Plain sets of bits for each language, n-gram by n-gram; languages beyond one mask."""
    rng = random.Random(3)
    words = {f"l{k:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüéñ", k=5)) for _ in range(12)] for k in range(70)}
    rows = [(100 * k + j, " ".join(rng.choices(words[lang], k=15)), lang) for k, lang in enumerate(sorted(words)) for j in range(3)]
    model = langid_bloom.fit(spark.createDataFrame([*rows, (9999, "x" * 70_000, "l000")], "doc_id long, text string, lang string"))
    assert len(model.tables) == 2 and model.langs == sorted(words)
    bits = {}
    for lang in model.langs:
        held = set()
        for size in langid_bloom.SIZES:
            counts = Counter(h for _, t, x in rows if x == lang for h in {(g ^ size) * 0x9E3779B97F4A7C15 % (1 << 64) for g in slow_grams(t, size)})
            held |= {h for h, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: langid_bloom.GRAMS]}
        bits[lang] = {int(langid_bloom.slot(np.uint64(h), k)) for h in held for k in range(langid_bloom.HASHES)}
    texts = [" ".join(rng.choices(words[lang], k=6)) for lang in list(words)[::7]] + ["é½ ²", "½ ² ① 12", "", None]
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(langid_bloom.predict(F.col("t"), model).alias("p")).collect()]
    for t, p in zip(texts, got):
        if not any(c.isalpha() for c in t or ""):
            assert tuple(p) == ("und", 0.0)
            continue
        grams, best = [(g ^ size) * 0x9E3779B97F4A7C15 % (1 << 64) for size in langid_bloom.SIZES for g in slow_grams(t, size)], []
        for lang in model.langs:
            hits = sum(all(int(langid_bloom.slot(np.uint64(h), k)) in bits[lang] for k in range(langid_bloom.HASHES)) for h in grams)
            rate = (len(bits[lang]) / (1 << langid_bloom.BITS)) ** langid_bloom.HASHES
            best.append((max((hits - rate * len(grams)) / (1 - rate), 0) / len(grams), lang))
        share, lang = max(best, key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        assert p["lang_pred"] == lang and abs(p["score"] - share) < 1e-9
    few = langid_bloom.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("lang < 'l005'"), per_lang=2)
    assert few.langs == [f"l{k:03}" for k in range(5)]


def test_toxicity_against_brute_force(spark):
    """Log-count ratios and scores by plain counting on a small fixture."""
    texts = ["you are vile and awful", "vile awful person you", "awful vile thing", "a calm and kind day", "kind words for a day", "calm day, kind person"]
    y = [1, 1, 1, 0, 0, 0]
    model = toxicity_nbsvm.train(texts, y, l2=1.0, rounds=40, least_df=1)
    slots = lambda t: {(g * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - toxicity_nbsvm.BITS) for g in slow_grams(t, 5)}
    held = [Counter(x for t, v in zip(texts, y) if v == label for x in slots(t)) for label in (0, 1)]
    for x in held[0] | held[1]:
        ratio = np.log((1 + held[1][x]) / 5 / ((1 + held[0][x]) / 5))
        assert (model.weights[x] == 0) if abs(ratio) <= 0.5 else (np.sign(model.weights[x]) == np.sign(ratio))
    asked = [*texts, "VILE!", "", None, "kind " * 50]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in asked], "t string").select(toxicity_nbsvm.score(F.col("t"), model).alias("s")).collect()]
    want = [1 / (1 + np.exp(-(sum(float(model.weights[x]) for x in slots(t or "")) + model.bias))) for t in asked]
    assert np.allclose(got, want, atol=1e-5) and [g >= 0.5 for g in got[:6]] == [True] * 3 + [False] * 3
    long = spark.createDataFrame([(1, "x" * 70_000), (2, "kind day"), (3, "vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity_nbsvm.fit(long, labels).weights.shape == (1 << toxicity_nbsvm.BITS,)


def test_embeddings_against_brute_force(spark, sf):
    e = q.read(spark, sf, "embeddings").select("vec_id", "embedding")
    bad = [(-1, None), (-2, [0.0] * 64), (-3, [float("nan")] * 64), (-4, [1.0] * 63 + [None]), (-5, []), (-6, [1.0, 2.0]), (-7, [2.0, 4.0])]
    df = e.unionByName(spark.createDataFrame(bad, "vec_id long, embedding array<float>")).unionByName(e.limit(3)).cache()
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64) if r["embedding"] and None not in r["embedding"] else np.array([])) for r in df.collect()]
    ok = lambda v: len(v) and np.isfinite(v).all() and (v != 0).any()
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok(rows[i][1]) and ok(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and rows[i][1] @ rows[j][1] / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= 0.9]
    n = np.zeros(len(rows), int)
    for i, j in links:
        n[[i, j]] += 1
    got = embed_pstable.embedding_groups(df).toPandas()
    assert len(got) == len(rows) and got["n_links"].sum() >= 0.9 * n.sum() and got["n_links"].sum() <= n.sum()
    comp, first = components(len(rows), links), {}
    for c, (v, _) in zip(comp, rows):
        first[c] = min(first.get(c, v), v)
    want = {v: first[c] for c, (v, _) in zip(comp, rows)}
    assert np.mean([want[v] == c for v, c in zip(got["vec_id"], got["component_id"])]) >= 0.99
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()
    split = embed_pstable.embedding_groups(df, split=8).toPandas()
    assert rows_of(split) == rows_of(got)
    assert embed_pstable.embedding_groups(df.where("false")).count() == 0


def test_link_counts_in_clusters(spark):
    """Groups of near copies of many sizes: counts are exact, no pair counts once a table."""
    rng = np.random.default_rng(11)
    centre = np.repeat(embed_pstable.unit(rng.standard_normal((60, 64))), rng.integers(1, 90, 60), axis=0)
    x = embed_pstable.unit(centre + 0.02 * rng.standard_normal(centre.shape))
    want = (x @ x.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    for split in (4096, 16):
        got = embed_pstable.embedding_groups(df, split=split).toPandas().set_index("vec_id")["n_links"].loc[range(len(x))].to_numpy()
        assert got.sum() >= 0.999 * want.sum() and (got <= want).all()
    h = embed_pstable.Hash(64, *embed_pstable.shape(len(x))).buckets(x)
    assert all(len(np.intersect1d(h[:, a], h[:, b])) == 0 for a in range(h.shape[1]) for b in range(a))
    other = embed_pstable.Hash(32, *embed_pstable.shape(len(x))).buckets(x[:, :32])
    assert not len(np.intersect1d(h, other))


def test_rows_without_an_id_link(spark):
    """Two vectors joined only through a row without an id, and a pair that has no id at all."""
    at = lambda d, k=0: [float(c) for c in np.eye(8)[k] * np.cos(np.radians(d)) + np.eye(8)[k + 1] * np.sin(np.radians(d))]
    rows = [(7, at(0)), (None, at(16)), (9, at(32)), (None, at(0, 4)), (None, at(5, 4)), (3, at(0, 6))]
    got = embed_pstable.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(3, 0, 3, True), (7, 1, 7, True), (9, 1, 7, False), (None, 1, None, True), (None, 1, None, True), (None, 2, 7, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_recall_at_the_threshold():
    """Pairs just over the threshold share a bucket, at the shape of any corpus size; unrelated ones rarely do."""
    rng = np.random.default_rng(1)
    a = embed_pstable.unit(rng.standard_normal((2000, 64)))
    o = rng.standard_normal((2000, 64))
    o = embed_pstable.unit(o - (o * a).sum(1, keepdims=True) * a)
    b = 0.9001 * a + np.sqrt(1 - 0.9001**2) * o
    for rows in (300, 50_000, 5_000_000):
        k, tables = embed_pstable.shape(rows)
        h = embed_pstable.Hash(64, k, tables)
        ha, hb, ho = h.buckets(a), h.buckets(b), h.buckets(o)
        assert (ha == hb).any(axis=1).mean() >= 0.95
        assert (ha == ho).mean() * rows <= 2 * embed_pstable.MEET
        assert (h.buckets(a, 1, 3) == ha[:, 1:3]).all()
    bits = np.unpackbits((h.sketch(a) ^ h.sketch(b)).view(np.uint8), axis=1).sum(1)
    assert bits.max() <= embed_pstable.reach(0.9) < 50


def test_vectors_with_clashing_columns(spark):
    rows = [(k, [1.0, k / 100], "x", 1) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, bucket int")
    assert rows_of(embed_pstable.embedding_groups(df).toPandas()) == rows_of(embed_pstable.embedding_groups(df.select("vec_id", "embedding")).toPandas())


def test_url_edges(spark):
    urls = [None, "", "no-scheme.com/en/7", "HTTP://Sub.Example.COM/en/7?x", "http://example.com/en/8", "x://user@a.co.uk:80#f", "http://1.2.3.4/a", "http://notexample.net/de/8", "http://example.net/de/8/9", "a://b://c.org/es/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("sub.example.com", "/en/7", "example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block")
    assert got[7][2:] == ("net/de/", "allow") and got[8][2:] == ("example.net/de/8", "block") and got[9][:2] == ("b:", "//c.org/es/")
    parts = {h: tuple(spark.range(1).select(*url_reputation.site_parts(F.lit(h))).first()) for h in ("a.b.co.uk", "x.example.com", "1.2.3.4", "localhost", "u@h.org:80")}
    assert parts == {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.example.com": ("example.com", "com"), "1.2.3.4": ("1.2.3.4", ""), "localhost": ("localhost", "localhost"), "u@h.org:80": ("h.org", "org")}
    clash = pages.withColumns({c: F.lit("x") for c in ("host", "path", "n", "bad", "domain")})
    none = spark.createDataFrame([], "page_id long, bad int")
    assert rows_of(url_reputation.filter_urls(clash, none).toPandas()) == rows_of(url_reputation.filter_urls(pages, none).toPandas())
    assert url_reputation.filter_urls(pages.where("false"), none).count() == 0
    dull = spark.createDataFrame([(None, "http://a.org/x"), (1, "http://a.org/x"), (1, "http://a.org/x"), (2, "http://a.org/" + "y" * 100_000)], "page_id long, url string")
    labels = spark.createDataFrame([(None, 1), (1, 1), (1, 0), (2, None)], "page_id long, bad int")
    assert url_reputation.filter_urls(dull, labels).count() == 4
    many = spark.createDataFrame([(k, f"http://{'bad' if k < 60 else 'good'}.site.org/") for k in range(120)], "page_id long, url string")
    out = url_reputation.filter_urls(many, many.select("page_id", (F.col("page_id") < 60).cast("int").alias("bad"))).groupBy("host", "verdict").count().collect()
    assert {(r["host"], r["verdict"]) for r in out} == {("bad.site.org", "block"), ("good.site.org", "allow")}


def test_reputation_against_brute_force(spark):
    """Priors, strengths by moments and posterior probabilities, computed plainly."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        suffix, d, h = rng.integers(0, 4), rng.integers(0, 6), rng.integers(0, 3)
        rate = [0.1, 0.3, 0.6, 0.9][suffix] if d else 0.95
        rows.append((k, f"h{h}.d{d}.s{suffix}", int(rng.random() < rate) if rng.random() < 0.6 else None))
    df = spark.createDataFrame(rows, "page_id long, host string, bad int")
    got = {r["host"]: r for r in url_reputation.host_reputation(df.select("page_id", "host"), df.select("page_id", "bad")).collect()}
    cut = {"h": lambda h: h, "d": lambda h: h.split(".", 1)[1], "s": lambda h: h.rsplit(".", 1)[1], "w": lambda h: ""}
    n, bad = {x: Counter() for x in cut}, {x: Counter() for x in cut}
    for _, h, b in rows:
        for x, of in cut.items():
            n[x][of(h)] += b is not None
            bad[x][of(h)] += b or 0
    up, prior, strength = {"h": "d", "d": "s", "s": "w"}, {"s": {}, "d": {}, "h": {}}, {}
    parent = {"s": lambda x: "", "d": lambda x: x.rsplit(".", 1)[1], "h": lambda x: x.split(".", 1)[1]}
    for x in ("s", "d", "h"):
        for c in n[x]:
            p = parent[x](c)
            k, mean = (1.0, 0.5) if x == "s" else (strength[up[x]], prior[up[x]][p])
            prior[x][c] = (bad[up[x]][p] - bad[x][c] + k * mean) / (n[up[x]][p] - n[x][c] + k)
        some = [c for c in n[x] if n[x][c]]
        over = sum(n[x][c] * (bad[x][c] / n[x][c] - prior[x][c]) ** 2 - prior[x][c] * (1 - prior[x][c]) for c in some)
        room = sum(prior[x][c] * (1 - prior[x][c]) * (n[x][c] - 1) for c in some)
        strength[x] = 1 / max(1 / 1001, min(over / room, 0.5)) - 1
    for h, r in got.items():
        a, b = bad["h"][h] + strength["h"] * prior["h"][h] + 0.5, n["h"][h] - bad["h"][h] + strength["h"] * (1 - prior["h"][h]) + 0.5
        assert abs(r["rate"] - a / (a + b)) < 1e-9
        x = (np.arange(200_000) + 0.5) / 200_000
        density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log(1 - x) - (a - 1) * np.log(a / (a + b)) - (b - 1) * np.log(b / (a + b)))
        assert abs(r["over"] - density[100_000:].sum() / density.sum()) < 2e-3 and r["blocked"] == (r["over"] >= 0.95)
    assert len({r["blocked"] for r in got.values()}) == 2


def slow_measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = {p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_edges(spark, odd, none):
    extra = ["a b c d e f g h i " * 3, "p q r s t u v w x y p q r s t u v w z", "l\nl\n\n l\nl"]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    got = sorted(((r["doc_id"] or -1), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_cascade.quality_report(docs).collect())
    assert got == sorted(((r["doc_id"] or -1), *slow_measures(r["text"])) for r in docs.collect())
    kept = quality_cascade.filter_documents(odd)
    assert kept.columns == odd.columns
    report = quality_cascade.quality_report(odd)
    assert report.where("kept and base_failed").count() == 0 and report.where("kept").count() == kept.count()
    assert quality_cascade.quality_report(none).count() == 0 and quality_cascade.filter_documents(none).count() == 0
    orders = [[r.name for r in quality_cascade.plan(docs)] for _ in range(3)]
    assert orders[0] == orders[1] == orders[2] and sorted(orders[0]) == sorted(r.name for r in quality_cascade.RULES)


def test_cascade_stops_at_the_first_rejection(spark):
    """The dear rule fails on the rows that the cheap rule rejects, so it must never see them."""
    cheap = quality_cascade.Rule("cheap", lambda m: m["n_symbols"] > 0, ("n_symbols",))
    dear = quality_cascade.Rule("dear", lambda m: F.when(m["n_symbols"] > 0, F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(m["n_repeat_words"] > 0), ("n_repeat_words",))
    docs = spark.createDataFrame([(k, "#" if k % 2 else "plain words") for k in range(40)], "doc_id long, text string")
    kept = docs.where(quality_cascade.verdict([cheap, dear], quality_cascade.measures(F.col("text"))))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 40, 2))
    with pytest.raises(Exception, match="evaluated"):
        docs.where(quality_cascade.verdict([dear, cheap], quality_cascade.measures(F.col("text")))).collect()
    found = {r.name: (share, cost) for share, cost, r in quality_cascade.estimates(docs, [cheap, *quality_cascade.RULES])}
    assert 0.3 < found["cheap"][0] < 0.7 and found["repeated_windows"][1] > found["too_few_words"][1] > 1


def test_license_edges(spark, none):
    texts = [None, "", "Under the MIT License", "cc by nc cc by nc x", "CC-BY-NC 4.0", "under the mit lic", "x " * 100 + "Licensed under the Apache License, Version 2.0. " + "y " * 50, "licensed under apache the version 2 0 license", "this work is licensed under the gnu general public license version", "é under the mit license under the mit license"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in license_join.scan(docs).collect()}
    assert got[0] == got[1] == (0, 0, None, None, "", "", 0.0)
    assert got[2][:6] == (4, 1, 0, 0, "mit", "mit") and got[3][:5] == (7, 2, 0, 3, "cc-by-nc") and got[4][:4] == (5, 1, 0, 0) and got[5][1] == 0
    assert got[6][1:6] == (1, 103, 103, "apache-2", "apache-2") and got[7][4:] == ("", "apache-2", 1.0)
    assert got[8][5] == "gpl-3" and 0.9 < got[8][6] < 1 and got[9][1:4] == (2, 1, 5)
    assert license_join.scan(none).count() == 0


def test_license_blocks_against_brute_force(spark, odd):
    """Every window of 48 words, notices interleaved with other words, and odd texts."""
    rng = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    for k in range(60):
        words = rng.choice(license_join.TEMPLATES)[1].split()
        gap = rng.choice([0, 1, 2, 3])
        some = [w for x in words for w in [x, *(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, gap)))] if rng.random() < 0.97]
        pad = lambda: [rng.choice(["the", "of", "and", "x", "y", "license"]) for _ in range(rng.randint(0, 90))]
        rows.append((1000 + k, " ".join([*pad(), *some, *pad()]).replace("k", "\u212a" if k == 5 else "K")))
    rows += [rows[20], (1, "second text of an id: under the MIT license")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, s string, row string")
    templates, want = [(label, set(t.split())) for label, t in license_join.TEMPLATES], []
    for d, t in rows:
        w = [x for x in re.split("[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        at = [(k, label) for p, label in license_join.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        share, labels = 0.0, {label for _, label in at}
        for label, tokens in templates:
            best = max((len(tokens & set(w[k : k + 48])) for k in range(len(w))), default=0) if tokens & set(w) else 0
            if best >= 0.9 * len(tokens) - 1e-9:
                share, labels = max(share, best / len(tokens)), labels | {label}
        first, last = (min(k for k, _ in at), max(k for k, _ in at)) if at else (None, None)
        want.append((d, len(w), len(at), first, last, ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), 1.0 if at else share))
    got = [tuple(r) for r in license_join.scan(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(bool(w[6]) and not w[5] for w in want) > 10


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nx", "\\", "\\<|", "<", "|>", None, "", "<\\|next|>", "a\n\nb", "😀é"]
    rows = [(c, t, role, nasty[(c + 3 * t) % len(nasty)]) for c in range(11) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", "odd\nrole <|nl|>", None, "assistant"])]
    rows += [(20, None, "user", "no turn"), (20, 1, "assistant", "tie b"), (20, 1, "assistant", "tie a"), (20, 1, "assistant", "tie a"), (None, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(turns).select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), "loss_mask")
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    for r in out.collect():
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r["conv_id"]), key=key)]
        assert [(x["role"], x["text"]) for x in r["t"]] == want
        assert r["loss"] == [t for role, t in want if role == "assistant"]
    merged = chat_format.format_conversations(turns.where("conv_id = 0")).first()["formatted"]
    assert merged.count(chat_format.OPEN) == 6 and merged.count(chat_format.NEXT) == 2
    digest = chat_format.digest(chat_format.format_conversations(turns.where("conv_id = 0"))).first()
    text = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in rows[:8])
    assert digest["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest() and digest["n_turns"] == 8
    assert chat_format.digest(chat_format.format_conversations(turns.where("false"))).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "[INST]" * 40_000, "x", 1), (1, 1, "assistant", "\\" * 100_000, "y", 2)], "conv_id long, turn long, role string, text string, formatted string, blocks int")
    got = chat_format.digest(chat_format.format_conversations(long)).first()
    assert got["loss_chars"] == 100_000 and got["loss_sha256"] == hashlib.sha256(b"\\" * 100_000).hexdigest() and got["formatted_chars"] == 40_000 * 7 + 200_000 + 21 + 26


def test_bpe_against_the_library(spark, sf, odd, none):
    import tiktoken

    lines = q.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    t = bpe_prefix.Tokenizer(lines, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=t.v.rank, special_tokens={})
    docs = q.read(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = {(r["doc_id"], r["text"]): r for r in docs.select("doc_id", "text", bpe_prefix.round_trip(F.col("text"), lines, public_tokenizers.PATTERN).alias("r")).collect()}
    for (_, text), r in got.items():
        ids = ref.encode_ordinary(text or "")
        assert (r["r"]["n_tokens"], r["r"]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["r"]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = odd.select("text", bpe_prefix.decode(bpe_prefix.encode(F.col("text"), lines, public_tokenizers.PATTERN), lines, public_tokenizers.PATTERN).alias("b")).collect()
    assert all(bytes(r["b"]).decode() == (r["text"] or "") for r in back)
    assert bpe_prefix.encoding_report(none, lines, public_tokenizers.PATTERN).count() == 0
    # A pattern whose matches cross white space is matched on whole texts.
    assert t.cuts
    for pattern in (r"\.\n|[^\n]+|\n", r"\w+ \w+|\s|\w+|[^\w\s]+", r"\p{L}+\s?|[^\p{L}]"):
        other = bpe_prefix.Tokenizer(lines, pattern)
        again = tiktoken.Encoding("own2", pat_str=pattern, mergeable_ranks=t.v.rank, special_tokens={})
        for text in ("one. two\nthree.\nfour five", "a b c d", " x  y\n\nz "):
            assert not other.cuts and other.encode(text) == again.encode_ordinary(text)
    rng = np.random.default_rng(5)
    for _ in range(200):
        s = bytes(rng.choice(list(b"abcdefghij the"), 120).tolist())
        a, b = sorted(rng.integers(0, 121, 2).tolist())
        new = bytes(rng.choice(list(b"xyz the"), int(rng.integers(0, 6))).tolist())
        p = bpe_prefix.PrefixEncoder(t.v, s[:50])
        p.append(s[50:])
        assert p.last == bpe_prefix.PrefixEncoder(t.v, s).last
        p.replace(a, b, new)
        fresh = bpe_prefix.PrefixEncoder(t.v, s[:a] + new + s[b:])
        assert p.last == fresh.last and p.ids() == fresh.ids() and p.data == fresh.data


def test_packing(spark, sf, odd, none):
    from tokenizers import Tokenizer

    spec = q.tokenizer_file("word_bpe_49k.json").decode()
    ref = Tokenizer.from_str(spec)
    extra = spark.createDataFrame([(7, "see <|endoftext|> and <|startoftext|>x"), (8, "I\u0307- \u0130- J\u030c, don't")], "doc_id long, text string")
    docs = q.read(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(extra)
    want = Counter()
    for r in docs.collect():
        ids = [*ref.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            want[r["doc_id"], k, at, len(part) // 4, zlib.crc32(part), part] += 1
    got = bestfit_pack.pack(docs, spec, tokens=True).toPandas()
    have = Counter(zip([None if d != d else int(d) for d in got["doc_id"]], *(got[c].tolist() for c in ("piece", "start", "length", "ids_crc32")), map(bytes, got["ids"])))
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= got["length"].sum() / 4096 * 1.15 + 8
    assert bestfit_pack.pack(none, spec).count() == 0


def test_segments_encode_as_the_whole_text(monkeypatch):
    """Random strings of characters that normalise, compose or match oddly, against unmodified library calls."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    spec, rng = q.tokenizer_file("word_bpe_49k.json").decode(), random.Random(4)
    ref, own = Tokenizer.from_str(spec), bestfit_pack.Encoder(spec)
    odd = [*"abcXYZiIjJ0129 '  \n\t.,-<|>=~", *map(chr, (0x338, 0x301, 0x307, 0x30C, 0x130, 0x131, 0x212A, 0x1E9E, 0xDF, 0xE9, 0xC9, 0xD7, 0xF7, 0xA0, 0x2028, 0x85, 0x1C, 0x4E2D, 0x3A3, 0xB2, 0x1F0, 0xAA, 0x200D, 0)), "'s", "'re", "don't", " <|endoftext|> "]
    for _ in range(60):
        texts = ["".join(rng.choices(odd, k=rng.randint(0, 12))) for _ in range(300)] + ["".join(chr(rng.randint(1, 0x250)) for _ in range(8)) for _ in range(50)]
        assert [x.tolist() for x in own.encode(pa.array(texts))] == [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bestfit_pack, "TABLE", 50)  # tables that are cleared all the time
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bestfit_pack, "STEP", 40)
    long = "a long text, in parts " * 9 + "\n" + "x" * 90
    assert [i for p in bestfit_pack.parts(long.encode()) for i in own.encode(pa.array([p]))[0].tolist()] == ref.encode(long, add_special_tokens=False).ids
    assert own.encode(pa.array([None, "", "a"]))[2].tolist() == ref.encode("a", add_special_tokens=False).ids
    plain, ref.encode_special_tokens = bestfit_pack.Encoder(spec, special_as_text=True), True
    assert plain.encode(pa.array(["<|endoftext|>"]))[0].tolist() == ref.encode("<|endoftext|>", add_special_tokens=False).ids


def test_packer_is_best_fit_and_bounded():
    """Against a plain list of open bins: least space that fits, of equals the one filled last; the fullest closes."""
    rng = np.random.default_rng(2)
    for most in (1, 2, 16):
        p, bins, made = bestfit_pack.Packer(50, most), [], 0
        for n in rng.integers(1, 51, 3000).tolist():
            fits = [k for k, (free, _) in enumerate(bins) if free >= n]
            if fits:
                free, b = bins.pop(min(fits, key=lambda k: (bins[k][0], -k)))
            else:
                free, b, made = 50, made, made + 1
            assert p.place(n) == (b, 50 - free)
            if free > n:
                bins.append((free - n, b))
            if len(bins) > most:
                bins.pop(min(range(len(bins)), key=lambda k: (bins[k][0], -k)))
        assert p.made == made and p.open <= most


def similar_pairs(texts, least=0.8):
    """Brute force: positions, in the order of ids, of texts whose 5-word shingle sets agree by `least`."""
    sets, holds = [], defaultdict(set)
    for k, (_, t) in enumerate(sorted(texts.items())):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
        for x in sets[-1]:
            holds[x].add(k)
    near = {(i, j) for s in holds.values() for i in s for j in s if i < j}
    return [(i, j) for i, j in near if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def test_similar_stage_tells_rows_apart_by_text(spark):
    """Rows without a key, and rows that share one, are decided by their texts."""
    near = " ".join(f"word{k}" for k in range(200))
    docs = [(None, "first of two"), (None, "second of two"), (None, "first of two"), (1, "a third"), (2, "a third"), (7, "one text of seven"), (7, "another text of the id seven"), (7, "one text of seven"), (None, near), (9, near + " more")]
    got = simhash_similar.keep_first(spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, __r0 string"))
    want = [(None, "first of two"), (None, "second of two"), (1, "a third"), (7, "one text of seven"), (7, "another text of the id seven"), (9, near + " more")]
    assert got.columns == ["doc_id", "text", "__r0"] and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_candidates_and_their_forest():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    rows = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, base.shape).astype(np.uint64)) for _ in range(12)])
    p = rows[rng.permutation(len(rows))]
    cuts = np.array([0, 1, 3, 100, 101, len(p)])
    part, cross = rng.integers(0, 2, len(p)), np.zeros(len(p), bool)
    cross[3:100] = True
    d = np.bitwise_count(p[:, None] ^ p).sum(2)
    run = np.searchsorted(cuts, np.arange(len(p)), "right")
    ok = np.triu(d <= simhash_similar.REACH, 1) & (run[:, None] == run) & ~(cross & (part[:, None] == part))
    i, j, bits = simhash_similar.close_pairs(p[:, 0].copy(), p[:, 1].copy(), cuts, part, cross)
    assert sorted(zip(i.tolist(), j.tolist(), bits.tolist())) == [(a, b, int(d[a, b])) for a, b in np.argwhere(ok).tolist()]
    k = forest(i, j, len(p))
    want = components(len(p), list(zip(i.tolist(), j.tolist())))
    assert components(len(p), list(zip(i[k].tolist(), j[k].tolist()))) == want and len(k) == len(p) - len(set(want))


def test_similar_trees_visit_boundary_shards():
    """Every pair whose summed triangle bound is 0 or 1 meets once, as a resident and another; no other pair does."""
    rng = np.random.default_rng(8)
    bits, vantage = rng.integers(0, 2, (60, 6), dtype=np.uint8), rng.integers(0, 2, 6, dtype=np.uint8)
    row, shard = simhash_similar.tree_shards(bits, vantage, 3)
    met = Counter(tuple(sorted((int(a), int(b)))) for a, s in zip(row[:60], shard[:60]) for b in row[shard == s] if a != b)
    bound = np.abs((bits ^ vantage)[:, None].astype(int) - (bits ^ vantage)).sum(2)
    # Two residents of one shard see each other from both sides.
    assert met == {(i, j): 2 if bound[i, j] == 0 else 1 for i in range(60) for j in range(i + 1, 60) if bound[i, j] <= 1}
    assert set(shard >> 6) == {3}


def test_forest_drops_every_link_inside_a_component():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 500, (2, 60_000))
    for n in (0, 1, 300, 60_000):
        k = forest(a[:n], b[:n], 500)
        want = components(500, list(zip(a[:n].tolist(), b[:n].tolist())))
        assert components(500, list(zip(a[k].tolist(), b[k].tolist()))) == want and len(k) == 500 - len(set(want))


def test_similar_pairs_among_shared_boilerplate(spark):
    """A large group just under the similarity, with pairs just over it: no closer-looking path may hide a pair."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    notice, texts = words(300), {}
    for k in range(0, 600, 2):
        own = words(46)
        texts[k] = " ".join(notice + own)
        texts[k + 1] = " ".join(notice + (own[:14] + words(32) if k < 200 else words(46)))
    want, docs = similar_pairs(texts), spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len(want) == 100
    for split in (simhash_similar.SPLIT, 40):  # with 40, most shards are dealt to pairs of parts
        prints, roots = simhash_similar.similar_roots(docs, split=split)
        key, groups = {r["node"]: r["first"]["key"] for r in prints.collect()}, defaultdict(set)
        for r in roots.collect():
            groups[r["root"]].add(key[r["node"]])
        got = {tuple(sorted(g)) for g in groups.values() if len(g) > 1}
        assert got <= set(want) and len(got) >= 0.95 * len(want)


def test_links_of_a_near_copy_group_grow_with_its_size(spark, monkeypatch):
    """Copies of one text in which 0 to 8 % of the words are replaced: links for each text stay few."""
    from fascicle.llm import common

    rng, links = np.random.default_rng(3), []
    base, texts = [f"w{x}" for x in rng.integers(0, 1 << 40, 150)], {}
    for k in range(600):
        changed, new = rng.random(150) < rng.random() * 0.08, rng.integers(0, 1 << 40, 150)
        texts[k] = " ".join(f"v{x}" if c else w for w, c, x in zip(base, changed, new))

    def durable(df):
        out = common.durable(df)
        if "same" in df.columns:
            links.append(out.count())
        return out

    monkeypatch.setattr(simhash_similar, "durable", durable)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash_similar.keep_first(docs, split=100).collect()}
    want = {k for k, c in enumerate(components(len(texts), similar_pairs(texts))) if c == k}
    assert len(kept - want) <= 0.01 * len(texts) and want <= kept
    assert links[0] < 8 * len(texts)


def test_dealing_leaves_out_pairs_of_a_large_group(spark):
    from fascicle.llm.common import deal, sampled

    # Key 0: groups of 6000 and 3000 rows and 900 rows of their own; key 1: 3000 such rows; key 2: 50.
    rows = spark.range(12_950).selectExpr("id", "int(case when id < 9900 then 0 when id < 12900 then 1 else 2 end) as key", "case when id < 6000 then -1 when id < 9000 then -2 else id end as root")
    out = deal(rows, sampled(rows, "id"), "key", "id", 1000, "root").toPandas()
    assert out.groupby("key").size()[2] == 50 and out.groupby(["key", "i", "j"]).size().max() < 2 * 1300
    met = Counter()
    for (key, i, j), run in out.groupby(["key", "i", "j"]):
        a, b = run[run.part == i], run[run.part == j]
        assert len(a) + (len(b) if i != j else 0) == len(run)
        for x, m in a.groupby(a.root.clip(upper=0)):
            for y, n in b.groupby(b.root.clip(upper=0)):
                met[key, *sorted((int(x), int(y)))] += len(m) * (len(m) - 1) // 2 if i == j and x == y else 0 if i == j and x > y else len(m) * len(n)
    assert {k: v for k, v in met.items() if v} == {(0, -2, -1): 6000 * 3000, (0, -1, 0): 6000 * 900, (0, -2, 0): 3000 * 900, (0, 0, 0): 900 * 899 // 2, (1, 0, 0): 3000 * 2999 // 2, (2, 0, 0): 50 * 49 // 2}


def test_rows_with_many_candidates_link_to_hubs():
    rng = np.random.default_rng(7)
    near, far = np.zeros((300, 2), np.uint64), rng.integers(0, 1 << 63, (20, 2), dtype=np.uint64)
    for k in range(24):  # bits of the base that a copy may have turned
        near[rng.random(300) < 0.5] ^= np.uint64(1) << np.uint64(k)
    p = np.concatenate([near, far, far[:5]])[rng.permutation(325)]
    row, hub = simhash_similar.hubs(p[:, 0].copy(), p[:, 1].copy(), np.arange(325))
    d = np.bitwise_count(p[:, None] ^ p).sum(2)
    assert len(row) == 299 and len(set(row.tolist())) == 299 and (d[row, hub] <= simhash_similar.REACH).all()
    assert len(set(components(325, list(zip(row.tolist(), hub.tolist()))))) == 325 - 299
    assert len(simhash_similar.hubs(far[:, 0].copy(), far[:, 1].copy(), np.arange(20))[0]) == 0


def test_common_shingles_by_products_and_by_holders():
    """Rows of the largest group are never counted from; what joins groups is the same as by brute force."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 40, 90):
        base, sets = rng.integers(0, 1 << 60, 120).astype(np.uint64), []
        for _ in range(n):
            own = np.where(rng.random(120) < rng.random() * 0.25, rng.integers(0, 1 << 60, 120).astype(np.uint64), base)
            sets.append(np.unique(own if rng.random() < 0.8 else own[:0]))
        group = np.unique(np.where(rng.random(n) < 0.4, 0, rng.integers(0, n, n)), return_inverse=True)[1]
        similar = [(i, j) for i in range(n) for j in range(i) if simhash_similar.jaccard(sets[i].tobytes(), sets[j].tobytes()) >= 0.8]
        same = [(i, int(np.flatnonzero(group == group[i])[0])) for i in range(n)]
        got = simhash_similar.joining(sets, group)
        assert components(n, same + got) == components(n, same + similar)
        assert all(group[i] != group[j] and simhash_similar.jaccard(sets[i].tobytes(), sets[j].tobytes()) >= 0.8 for i, j in got)


def test_stages_on_odd_and_empty_tables(spark, sf, odd, none):
    import corpus_pipeline as c

    for name, stage in c.STAGES:
        out = stage(spark, odd, sf)
        if name == "packing":
            assert out.count() >= odd.count() and out.where("doc_id is null").count() == 1
        else:
            assert out.columns == odd.columns and out.count() <= odd.count()
        assert stage(spark, none, sf).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.01"
    docs, labels = q.read(spark, sf, "documents"), {r["doc_id"]: r["toxic"] for r in q.read(spark, sf, "labels").collect()}
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept, before = {r["doc_id"]: r["text"] for r in out.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(kept) <= set(before)
        if name == "toxicity":
            toxic = [d for d in before if labels.get(d) == 1]
            assert sum(d in kept for d in toxic) < 0.2 * len(toxic) and len(kept) > 0.85 * len(before)
        elif name == "quality":
            assert all(slow_measures(t)[0] >= 20 for t in kept.values())
        else:
            comp = components(len(before), similar_pairs(before))
            ids = sorted(before)
            assert sorted(kept) == sorted({ids[x] for x in comp}) and len(kept) < len(before)
        docs = spark.createDataFrame(out.collect(), out.schema)
    packed = c.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
