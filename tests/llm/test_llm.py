"""The training-data operators on small fixtures: brute force, round trips and held-out accuracy, with nulls, empty and
long texts, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from marketlens.llm import bloom_lookup, boosted_trees, chunks, common, jaccard_join, license_scan, packing, ppm, prefix_bpe, quality_rules, range_coder, url_filter
from marketlens.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, score string, ids string, part string, extra int"
random.seed(7)
VOCABULARY = ["the", "of", "and", "to", "in", "river", "stone", "cloud", "letter", "garden", "winter", "music", "Straße", "été"]


def sentence(n, rng=random):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE = sentence(200)
TEXTS = [None, "", " \n ", "one", "two words", BASE, BASE, BASE + " more", "a\tb  c\r\nd", sentence(30_000), "# $ % | < > ! " * 40, "日本語 テキスト 🎈", sentence(12) + ".\n" + sentence(40) + "!"]
ROWS = [(k, t, "en", "x", "y", "z", 1) for k, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "x", "y", "z", 1), (None, "no id here at all", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_prefix_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = prefix_bpe.read_ranks(path)
    usual = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = prefix_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    got = prefix_bpe.decode_documents(encoded, path).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = dict((row[0], row[1]) for row in ROWS)[r["doc_id"]] or ""
        assert r["ids"] == usual.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert prefix_bpe.encode_documents(none, path, public_tokenizers.PATTERN).count() == 0
    encoder = prefix_bpe.TextEncoder(ranks, public_tokenizers.PATTERN)
    alphabet = "abc 's'll\n\n  \t.,!?éß日1 THE"
    for _ in range(200):
        live = prefix_bpe.EditableText(encoder, "".join(random.choice(alphabet) for _ in range(40)))
        for _ in range(4):
            a = random.randint(0, len(live.text))
            b = random.choice([a, min(len(live.text), a + random.randint(0, 9))])
            live.replace(a, b, "".join(random.choice(alphabet) for _ in range(random.randint(0, 7))))
            assert live.ids() == usual.encode_ordinary(live.text)
    data = b"the cat" * 20
    changed, table = encoder.bpe.edit(data, encoder.bpe.prefixes(data), 10, 13, b"dog")
    assert table == encoder.bpe.prefixes(changed)


def test_library_chunks():
    from tokenizers import Tokenizer

    alphabet = "abc 's'll\n\n  \t.,!?éüß日本12 \x1c\x85\xa0 THEΣİ é É"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(500)] + ["<|endoftext|> a", "word " * 500]
    for name, build in (("byte_bpe_50k.json", chunks.byte_level), ("word_bpe_49k.json", chunks.word_level)):
        whole = Tokenizer.from_file(public_tokenizers.path(name))
        for text, got in zip(texts, build(public_tokenizers.path(name)).encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ppm(docs, none):
    settings = ppm.Settings(order=3, block_bytes=20_000, shards=8, fan=2)
    learnt = common.crc_of_id() % 7 != 2
    got = ppm.score(docs, learnt, settings).collect()
    assert len(got) == len(ROWS)
    train = [ppm.words_of(t) for i, t, *_ in ROWS if i is not None and common.crc_of_id_py(i) % 7 != 2]
    counts = Counter(w for words in train for w in words)
    counts[None] = len(train)
    n, v = sum(counts.values()), len(counts)
    model = ppm.AdaptiveModel(3)
    for words in train:
        data = b"   " + b" ".join(words) + b"\n"
        for p in range(3, len(data)):
            for k in range(4):
                seen = model.trie[k].setdefault(data[p - k : p], {})
                seen[data[p]] = seen.get(data[p], 0) + 1
    texts = {i: ppm.words_of(t) for i, t, *_ in ROWS}
    for r in got:
        words = texts[r["doc_id"]]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(words) + 1, n, sum(counts[w] > 0 for w in [*words, None]))
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*words, None]))
        assert r["score"] == pytest.approx(model.code(words, learn=False), abs=1e-6)
    assert ppm.score(none, learnt, settings).count() == 0
    alone = ppm.score(docs.where("doc_id = 5").limit(1), F.lit(False), settings).first()
    assert alone["score"] == pytest.approx(-(len(BASE.encode()) + 1) * np.log10(252))
    assert by_id(ppm.score_adaptive(docs, 2))[5]["score"] > alone["score"]


def test_ppm_sums_to_one():
    trie = ppm.ContextTrie(*np.unique(ppm.grams_of([b"abracadabra", b"bar"], 2), return_counts=True), 2)
    for context in (b"ab", b"zz", b"ra", b"  "):
        grams = np.array([context[0] << 16 | context[1] << 8 | b for b in range(256) if b not in (9, 11, 12, 13)], np.uint64)
        assert (10 ** trie.code(grams)).sum() == pytest.approx(1)


def test_license_scan(spark, docs, none):
    mit, gpl = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["GPL-3.0"]
    rows = [(1, sentence(30) + "\n" + mit), (2, mit.upper()), (3, sentence(20) + " " + gpl.replace("work", "file") + " " + sentence(5)), (4, sentence(60)), (5, mit + " " + sentence(9) + " " + mit), (6, license_scan.TEMPLATES["MIT-text"])]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["license"]) for r in got) == Counter({(1, "MIT"): 1, (2, "MIT"): 1, (5, "MIT"): 2, (6, "MIT-text"): 1} | ({(3, "GPL-3.0"): 1} if any(r["doc_id"] == 3 for r in got) else {}))
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(none).count() == 0


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path, size=512).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    texts = {i: t or "" for i, t, *_ in ROWS}
    expected = Counter()
    for i, *_ in ROWS:
        ids = np.array(whole.encode(texts[i], add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 512):
            expected[(i, k // 512, k, len(ids[k : k + 512]), ids[k : k + 512].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == expected
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(none, path).count() == 0


def test_packing_plan():
    counts = {random.randint(1, 100): random.randint(1, 50) for _ in range(60)}
    made = packing.plan(counts, 100)
    used = Counter()
    for p in made:
        assert sum(p.lengths) <= 100
        for n in p.lengths:
            used[n] += p.times
    assert used == counts
    assert sum(p.times for p in made) <= 1.1 * packing.fewest(sum(n * c for n, c in counts.items()), 100) + 1
    # greedy leaves 6 + 3 of 10; the 3 gives way to 2 + 2
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0].lengths == (6, 2, 2)


def test_fingerprints(docs, none):
    rows = sorted(((i if i is not None else -(1 << 63)), t or "") for i, t, *_ in ROWS)
    got = bloom_lookup.fingerprint_versions(docs).collect()
    expected = Counter()
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        expected[(i, hashlib.sha256(bloom_lookup.edit_of(t, following).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), hashlib.sha256(r["edited"].encode()).hexdigest()) for r in got) == expected
    same = [r["fingerprint"] for r in got if r["doc_id"] in (5, 6)]
    assert len(set(same)) == 1
    assert bloom_lookup.fingerprint_versions(none).count() == 0
    a, b = bloom_lookup.digests(BASE + ".\n" + sentence(90) + "\nx"), bloom_lookup.digests(sentence(50) + "\nx")
    mine, theirs = bloom_lookup.differing(a, b)
    assert set(mine) == set(a) - set(b) and set(theirs) == set(b) - set(a)
    repeats = "ab\n" * 150 + "\n" * 30
    assert len(set(bloom_lookup.digests(repeats).tolist())) == len(bloom_lookup.paragraphs(repeats))


def test_url_filter(spark):
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/")]
    link = '<link href="http://a.org/1" rel="canonical">'
    rows = [
        (1, "http://x.example.com/en/a", ""), (2, "https://WWW.example.com/en/a", link), (3, "http://other.com", ""), (4, "http://other.com/x?y", ""), (5, None, ""), (6, "nothing", None),
        (7, "http://a.org/1?utm_source=x", ""), (8, "http://b.org/z", '<meta http-equiv="refresh" content="0; url=http://x.example.com/en/q">'), (9, "http://b.org/z/#top", ""), (10, "http://c.org/", '<link rel=canonical href="/z">'),
        (11, "http://myexample.com/en/", ""), (12, "http://d.org/", "<link rel='canonical' href='http://b.org/z'>"),
    ]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert {k: (r["rule"], r["verdict"]) for k, r in got.items()} == {
        1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: (None, "allow"), 4: ("com/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"),
        9: (None, "block"), 10: (None, "allow"), 11: ("com/", "allow"), 12: (None, "block"),
    }
    assert (got[2]["host"], got[2]["path"], got[3]["path"], got[5]["host"]) == ("www.example.com", "/en/a", "", "")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(60, 80)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, **{k: 60 for k in [*range(60, 80), 100]}, 200: 200, 201: 200}


def test_range_coder(docs, none):
    for n in (0, 1, 5, 4096, 9000):
        ids = np.random.default_rng(n).integers(0, 50_257, n)
        assert (range_coder.decode_blocks(range_coder.encode_blocks(ids)) == ids).all()
    blocks = range_coder.encode_blocks(np.arange(5000) % 300)
    words = blocks[0][2].copy()
    words[50] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode_blocks([(blocks[0][0], blocks[0][1], words), *blocks[1:]])
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, at, expected = Tokenizer.from_file(path), 0, Counter()
    for i, t in sorted((i if i is not None else -(1 << 63), t or "") for i, t, *_ in ROWS):
        ids = np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4")
        expected[(i, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    got = range_coder.read_files(range_coder.write_files(docs, path)).collect()
    assert Counter((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in got) == expected
    assert range_coder.read_files(range_coder.write_files(none, path)).count() == 0


def test_classifier(spark, docs, none):
    rng = random.Random(1)
    rows = [(k, sentence(rng.randint(5, 80), rng) if k % 3 else " | ".join(sentence(40, rng).split()), k % 3 and 1) for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    forest = boosted_trees.train(table.drop("quality"), table.drop("text"), common.crc_of_id() % 5 != 0)
    scored = by_id(boosted_trees.classify(table, forest))
    held = [(scored[k]["predicted"], q) for k, _, q in rows if common.crc_of_id_py(k) % 5 == 0]
    assert sum(p == bool(q) for p, q in held) >= 0.97 * len(held)
    got = boosted_trees.classify(docs, forest)
    assert got.count() == len(ROWS) and got.where("score between 0 and 1").count() == len(ROWS)
    assert boosted_trees.classify(none, forest).count() == 0
    empty = boosted_trees.train(none, table.drop("text"), F.lit(True))
    assert boosted_trees.classify(docs, empty).select("score").distinct().count() == 1


def test_jaccard_join(spark, docs, none):
    rng = random.Random(3)
    rows = [(k, t) for k, t, *_ in ROWS if k is not None]
    seed = [sentence(1, rng) + str(rng.randint(0, 10**6)) for _ in range(120)]
    for k in range(100, 160):
        words = list(seed)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"edit{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, " ".join(seed[:40] + [f"w{rng.randint(0, 10**6)}" for _ in range(200)])) for k in range(60)]
    rows += [(300, "a b c d"), (301, "A B  c\nd"), (302, "a b c d e")]
    sets = {}
    for i, t in rows:
        w = [x.decode("utf-8") for x in common.words_of(t)]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in sets}
    assert jaccard_join.join(docs).count() == len(ROWS) and jaccard_join.join(none).count() == 0


def test_count_tree():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 9, (300, 32))
    sizes = points.sum(axis=1)
    tree = jaccard_join.CountTree(sizes, points)
    for k in range(0, 300, 17):
        near = np.minimum(points, points[k]).sum(axis=1) >= jaccard_join.least_overlap(sizes + sizes[k], 60)
        assert set(np.flatnonzero(near)) == set(tree.partners(int(sizes[k]), points[k], 60).tolist())


def test_quality_rules(spark, docs, none):
    import re

    got = quality_rules.measure(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == len(ROWS)
    rng = random.Random(2)
    rows = [(k, "\n".join(sentence(rng.randint(1, 9), rng) for _ in range(rng.randint(0, 30))) + rng.choice(["", " \n", "\n# $"]), "en") for k in range(80)]
    rows = [(k, t + ("\n" + t[: len(t) // 3]) * (k % 3), g) for k, t, g in rows]
    for r in quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        t = r["text"]
        words = re.findall("[^\x20\x09-\x0d]+", t)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    assert quality_rules.measure(none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, folder), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == kept and 100 < len(kept) < 200
