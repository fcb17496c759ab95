"""Every registered query of the subpackage by name, over small whole tables with nulls, empty and long texts, repeated rows
and ids, near copies and special strings, against plain Python, the libraries or DuckDB."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import bloom_lookup, boosted_trees, common, jaccard_join, license_scan, ppm, prefix_bpe, quality_rules, range_coder, registry, url_filter

rng = random.Random(11)
WORDS = [f"{a}{b}{c}" for a in ("ri", "sto", "clou", "ga", "win", "mu") for b in ("ver", "ne", "den", "ter") for c in ("", "s", "ly")] + "the of and to in a is that".split()


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def edited(text, n, r=rng):
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def texts():
    base, other = prose(150), prose(400)
    rows = [(k, t) for k, t in enumerate([None, "", " \n\t", "one", "a b c d", "A B  c\nd", base, base, edited(base, 2), edited(base, 9), edited(base, 25), prose(9_000), "\n".join(prose(12) for _ in range(30)), "x " * 300, "# $ % | <b> !" * 30, "日本語 テキスト 🎈 été Straße", "<|endoftext|> river <|startoftext|>\n\n" + prose(20), "İstanbul \x85   tail  "])]
    for k in range(20, 60):
        rows.append((k, edited(other, rng.randint(0, 14))))
    rows += [(k, prose(rng.randint(1, 300))) for k in range(60, 90)]
    rows += [(6, base), (60, other), (None, other + " more"), (None, prose(40)), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def folder(tmp_path_factory, rows):
    path = tmp_path_factory.mktemp("tables")
    n = len(rows)
    pq.write_table(pa.table({
        "doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "lang": pa.array([["en", "fr", "xx", None][k % 4] for k in range(n)], pa.string()),
        "source": ["s"] * n, "n_chars": pa.array([len(t or "") for _, t in rows], pa.int64()), "score": ["clash"] * n, "ids": ["clash"] * n, "part": ["clash"] * n, "key": ["clash"] * n,
    }), f"{path}/documents.parquet", row_group_size=20)
    known = sorted({i for i, _ in rows if i is not None})
    pq.write_table(pa.table({"doc_id": pa.array(known, pa.int64()), "quality": pa.array([i % 3 and 1 for i in known], pa.int32()), "toxic": pa.array([0] * len(known), pa.int32())}), f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def nothing(tmp_path_factory, folder):
    path = tmp_path_factory.mktemp("nothing")
    for name in ("documents", "labels"):
        pq.write_table(pq.read_table(f"{folder}/{name}.parquet").slice(0, 0), f"{path}/{name}.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "label": pa.array([], pa.int32())}), f"{path}/embeddings.parquet")
    pq.write_table(pa.table({"conv_id": pa.array([], pa.int64()), "turn": pa.array([], pa.int64()), "role": pa.array([], pa.string()), "text": pa.array([], pa.string())}), f"{path}/conversations.parquet")
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}), f"{path}/pages.parquet")
    return str(path)


def run(spark, name, folder):
    return registry.QUERIES[name](spark, folder)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert run(spark, name, nothing).count() == 0


def test_op1(spark, folder, rows):
    got = run(spark, "op1_ppm_score", folder)
    assert got.dtypes[:7] == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    learnt = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    train = [common.words_of(t) for i, t in rows if learnt(i)]
    counts = Counter(w for words in train for w in words)
    counts[None] = len(train)
    n, v = sum(counts.values()), len(counts)
    model = ppm.AdaptiveModel(5)
    for words in train:
        data = b" " * 5 + b" ".join(words) + b"\n"
        for p in range(5, len(data)):
            for k in range(6):
                seen = model.trie[k].setdefault(data[p - k : p], {})
                seen[data[p]] = seen.get(data[p], 0) + 1
    expected, scores = Counter(), {}
    for i, t in rows:
        words = common.words_of(t)
        base = sum(math.log10((counts[w] + 1) / (n * 1.0 + v + 1)) for w in [*words, None])
        expected[(i, i is None or zlib.crc32(str(i).encode()) % 7 == 2, len(words) + 1, sum(counts[w] > 0 for w in [*words, None]), n, round(base, 6))] += 1
        if len(words) < 500:
            scores.setdefault((i, len(words)), []).append(model.code(words, learn=False))
    # the base: (c + 1) / (N + 1 * (V + 1)) with V + 1 kinds, the unknown one included
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.collect()) == expected
    for r in got.collect():
        if r["n_tokens"] <= 500:
            assert any(math.isclose(r["score"], s, abs_tol=1e-6) for s in scores[(r["doc_id"], r["n_tokens"] - 1)])


def best_windows(text, template):
    """The best containment of the template's shingles in any window of its length, by plain tuples."""
    words, wanted = (license_scan.bare_words(x)[0] for x in (text, template))
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    want = {tuple(wanted[k : k + 5]) for k in range(len(wanted) - 4)}
    size = min(len(wanted) - 4, len(grams))
    return max((len(want & set(grams[k : k + size])) / len(want) for k in range(len(grams) - size + 1)), default=0.0)


def test_op2_against_every_window(spark, tmp_path):
    r = random.Random(5)
    templates = license_scan.TEMPLATES | license_scan.FULL_TEXTS
    rows = [(0, None), (1, ""), (2, "few words"), (3, prose(3000, r))]
    for name, template in sorted(templates.items()):
        for _ in range(6):
            words = template.split()
            for _ in range(r.choice([0, 1, 2, len(words) // 30, len(words) // 20])):
                k = r.randrange(len(words))
                words[k : k + 1] = r.choice([[], ["changed"], [words[k], "added"]])
            rows.append((len(rows), prose(r.randint(0, 60), r) + " " + " ".join(words) + "\n" + prose(r.randint(0, 60), r)))
    rows += rows[10:12]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "license": ["clash"] * len(rows)}), f"{tmp_path}/documents.parquet")
    got = Counter()
    for x in run(spark, "op2_license_scan", str(tmp_path)).collect():
        got[(x["doc_id"], x["license"])] += 1
        assert x["containment"] >= 0.8 and 0 <= x["first_word"] < x["end_word"]
    due = {(i, name) for i, t in rows for name, template in templates.items() if t and best_windows(t, template) >= 0.8}
    assert set(got) <= due and len(due) > 120 and len(set(got) & due) >= 0.98 * len(due)
    assert all(got[(i, name)] >= 2 for i, name in got if i in (10, 11))  # repeated rows are scanned each


def library(name, end):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: np.array(whole.encode(t or "", add_special_tokens=False).ids + [end], "<u4")


def test_op3(spark, folder, rows):
    got = run(spark, "op3_best_two_fit", folder)
    assert got.dtypes[:7] == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    encode, expected, total = library("word_bpe_49k.json", 1), Counter(), 0
    for i, t in rows:
        ids = encode(t)
        total += len(ids)
        for k in range(0, len(ids), 4096):
            expected[(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))] += 1
    pieces = got.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == expected
    held = {}
    for r in pieces:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(held) <= math.ceil(total / 4096) + 1


def test_op4(spark, folder, rows):
    ordered = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in rows))
    expected = Counter()

    def near(a, b):
        x, y = (Counter(bloom_lookup.paragraphs(t)) for t in (a, b))
        return 1.0 if not x and not y else sum((x & y).values()) / sum((x | y).values())

    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + following[:half]
        expected[(i, len(t), hashlib.sha256(edit.encode()).hexdigest(), round(near(t, edit), 9), round(near(t, following), 9))] += 1
    got = run(spark, "op4_bloom_lookup", folder)
    assert got.dtypes == [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
    made = got.collect()
    assert Counter((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in made) == expected
    by_text = {}
    for r in made:
        if r["doc_id"] in (6, 7):
            by_text.setdefault("base", set()).add(r["fingerprint"])
    assert len(by_text["base"]) == 1


def test_lookup_tables_grow_only_as_needed():
    r = random.Random(3)
    for a, b in ((0, 0), (5, 0), (0, 40), (300, 300), (900, 20)):
        both = np.array([r.getrandbits(64) for _ in range(500)], np.uint64)
        x, y = (np.sort(np.concatenate([both, np.array([r.getrandbits(64) for _ in range(n)], np.uint64)])) for n in (a, b))
        mine, theirs = bloom_lookup.differing(x, y)
        assert set(mine.tolist()) == set(x.tolist()) - set(y.tolist()) and set(theirs.tolist()) == set(y.tolist()) - set(x.tolist())
    one = bloom_lookup.digests("\n".join(prose(8, r) for _ in range(400)) + "\n" * 50)
    assert len(bloom_lookup.differing(one, one)[0]) == 0 and bloom_lookup.likeness(one, one) == 1.0


def linked_pages(n=300):
    r = random.Random(9)
    hosts = ["a.org", "b.net", "c.net", "example.com", "www.example.com", "x.example.com"]
    url = lambda: f"http://{r.choice(hosts)}/{r.choice(['en', 'es', 'fr', 'de'])}/{r.randrange(60)}"
    rows = []
    for k in range(n):
        html = "<html>" + (f'<link rel="canonical" href="{url()}">' if r.random() < 0.35 else "") + (f"<meta http-equiv='refresh' content='0; url={url()}'>" if r.random() < 0.15 else "")
        rows.append((k, url() + r.choice(["", "/", "?utm_source=q", "#top"]), html))
    return rows + [(n, None, None), (n + 1, "no scheme", "<b>"), (n + 2, rows[0][1], rows[0][2])]


def test_op5_on_linked_pages(spark, tmp_path):
    pages = linked_pages()
    pq.write_table(pa.table({"page_id": [p[0] for p in pages], "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string()), "host": ["clash"] * len(pages), "verdict": ["clash"] * len(pages), "component": ["clash"] * len(pages)}), f"{tmp_path}/pages.parquet")
    got = run(spark, "op5_redirect_equivalence", str(tmp_path))
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    con = duckdb.connect()
    con.execute(f"create view pages as select page_id, url, html from '{tmp_path}/pages.parquet'")
    cur = con.execute(registry.ORACLES["op5_redirect_equivalence"])
    names = [c[0] for c in cur.description]
    expected = sorted(repr([dict(zip(names, row))[c] for c in got.columns]) for row in cur.fetchall())
    made = got.collect()
    assert sorted(repr([r[c] for c in got.columns]) for r in made) == expected
    # plain Python: a search over the links
    import re

    key = lambda u: re.sub("^[^:]*://", "", re.sub("[#].*|[?]utm_.*", "", u)).rstrip("/")
    near = {}
    for _, u, h in pages:
        for t in re.findall("href=\"([^\"]+)|url=([^']+)", h or ""):
            a, b = key(u), key("".join(t))
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    rules = registry.URL_RULES

    def own(u):
        host, path = u.split("/", 1)[0], "/" + u.split("/", 1)[1]
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        return max(fits, key=lambda x: len(x.name)).verdict if fits else None

    for r in made:
        u = dict((p[0], p[1]) for p in pages)[r["page_id"]]
        if not u or "://" not in u:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == ("", "", None, "allow")
            continue
        seen, left = {key(u)}, [key(u)]
        while left:
            for b in near.get(left.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    left.append(b)
        assert r["verdict"] == (own(key(u)) or ("block" if any(own(x) == "block" for x in seen) else "allow"))
    assert 10 < sum(r["verdict"] == "block" and r["rule"] is None for r in made)


def test_op5_with_relative_links_in_sql(spark, tmp_path):
    r = random.Random(2)
    targets = ["../en/1", "./2", "?p=3", "/es/../fr/4", "//b.net/es/5", "#x", "..", ".", "6.html", "../../7/", "mailto:a@b.net", "http://c.net/fr/./8/../9", "/en/10?u=../x"]
    rows = []
    for k in range(150):
        html = "".join(r.choice(["<link rel='canonical' href='{}'>", '<LINK href="{}" rel="canonical"/>', '<meta http-equiv="refresh" content="3; URL={}">', "<a href='{}'>"]).format(r.choice(targets)) for _ in range(r.randint(0, 3)))
        base = r.choice(["", "", "<base href='http://b.net/es/'>", '<base target="_top" href="../fr/">'])
        rows.append((k, f"http://{r.choice(['a.org', 'b.net', 'x.example.com'])}/{r.choice(['en', 'es', 'fr'])}/{r.choice(['', 'q', 'q/z', 'q?p=3'])}", base + html))
    pq.write_table(pa.table({"page_id": [x[0] for x in rows], "url": [x[1] for x in rows], "html": [x[2] for x in rows]}), f"{tmp_path}/pages.parquet")
    got = run(spark, "op5_redirect_equivalence", str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    cur = con.execute(registry.ORACLES["op5_redirect_equivalence"])
    names = [c[0] for c in cur.description]
    made = got.collect()
    assert sorted(repr([x[c] for c in got.columns]) for x in made) == sorted(repr([dict(zip(names, row))[c] for c in got.columns]) for row in cur.fetchall())
    assert len({x["component"] for x in made}) < 100


def test_op6(spark, folder, rows):
    got = run(spark, "op6_range_coder", folder)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    encode, at, expected = library("byte_bpe_50k.json", 2), 0, []
    special = library("byte_bpe_50k.json", 2)("<|endoftext|>")
    assert special.tolist() == [50256, 2]
    for i, t in sorted((-(1 << 63) if i is None else i, t or "") for i, t in rows):
        ids = encode(t)
        expected.append((i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    made = sorted(got.collect(), key=lambda r: r["start"])
    assert Counter((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in made) == Counter(expected)
    ids = [-(1 << 63) if r["doc_id"] is None else r["doc_id"] for r in made]
    assert ids == sorted(ids) and [r["start"] for r in made] == [0, *np.cumsum([r["n_tokens"] for r in made])[:-1]]


def test_blocks_beat_the_entropy_of_their_ids():
    r = np.random.default_rng(4)
    words = [r.integers(0, 50_000, r.integers(1, 4)) for _ in range(3000)]
    ids = np.concatenate([words[min(2999, int(k))] for k in r.zipf(1.25, 30_000) - 1])
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    bits = sum(16 * len(w) for *_, w in range_coder.encode_blocks(ids, bound=range_coder.bound_of(ids))) / len(ids)
    assert bits < -(share * np.log2(share)).sum() < 8 * len(zlib.compress(ids.astype("<u2").tobytes())) / len(ids) + 2
    data = bytearray(range_coder.write_frame([7], [len(ids)], ids, 0))
    assert (range_coder.read_frame(bytes(data))[2] == ids).all()
    for at in (0, 36, 40, len(data) - 500):
        broken = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
        with pytest.raises(ValueError):
            range_coder.read_frame(bytes(broken))
    with pytest.raises(ValueError):
        range_coder.encode_blocks(np.array([5000]), bound=4096)


def test_op7(spark, folder, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    usual = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(path), special_tokens={})
    expected = Counter()
    for i, t in rows:
        ids = usual.encode_ordinary(t or "")
        expected[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = run(spark, "op7_prefix_bpe", folder)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert Counter(map(tuple, got.collect())) == expected


def plain_forest(x, y, trees, depth, rate, bins, ridge, least):
    """The same trees by plain loops: lists of nested (feature, threshold, left, right) and leaf values."""
    base = math.log((sum(y) + 1) / (len(y) - sum(y) + 1))
    cuts = [sorted(set(np.quantile([r[j] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(len(x[0]))]
    margin, out = [base] * len(y), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]

        def grow(rows, level):
            sg, sh = sum(g[k] for k in rows), sum(h[k] for k in rows)
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j, marks in enumerate(cuts):
                    for c in marks:
                        low = [k for k in rows if x[k][j] <= c]
                        if len(low) < least or len(rows) - len(low) < least:
                            continue
                        lg, lh = sum(g[k] for k in low), sum(h[k] for k in low)
                        gain = lg**2 / (lh + ridge) + (sg - lg) ** 2 / (sh - lh + ridge) - sg**2 / (sh + ridge)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, j, c, low)
            if best is None:
                value = rate * sg / (sh + ridge)
                for k in rows:
                    margin[k] += value
                return value
            _, j, c, low = best
            inside = set(low)
            return (j, c, grow(low, level + 1), grow([k for k in rows if k not in inside], level + 1))

        out.append(grow(list(range(len(y))), 0))
    return base, out


def plain_score(forest, row):
    base, trees = forest
    total = base
    for node in trees:
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        total += node
    return 1 / (1 + math.exp(-total))


def test_trees_grow_and_score_as_plain_ones():
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(90, 4)), 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    settings = {"trees": 6, "depth": 3, "rate": 0.3, "bins": 8, "ridge": 1.0, "least": 5}
    forest, plain = boosted_trees.fit(x, y, **settings), plain_forest(x.tolist(), y.tolist(), **settings)
    more = np.round(r.normal(size=(200, 4)), 2)
    assert np.allclose(forest.score(more), [plain_score(plain, row) for row in more.tolist()])
    assert np.allclose(forest.score(x), [plain_score(plain, row) for row in x.tolist()])


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    n = labels.sum()
    return (ranks[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_op8(spark, folder, rows):
    got = run(spark, "op8_boosted_trees", folder)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    made = got.collect()
    assert Counter(r["doc_id"] for r in made) == Counter(i for i, _ in rows)
    for r in made:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["doc_id"] is None or r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    known = sorted({i for i, _ in rows if i is not None})
    learn = [(boosted_trees.statistics(t), float(i % 3 and 1)) for i, t in rows if i in known and zlib.crc32(str(i).encode()) % 5 != 0]
    learn.sort()
    forest = boosted_trees.fit(np.array([a for a, _ in learn]), np.array([b for _, b in learn]))
    by_text = {}
    for i, t in rows:
        by_text.setdefault(i, set()).add(round(float(forest.score(np.array([boosted_trees.statistics(t)]))[0]), 9))
    assert all(round(r["score"], 9) in by_text[r["doc_id"]] for r in made)


def test_op8_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in run(spark, "op8_boosted_trees", folder).where("held_out").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    both = [(got[i]["score"], q) for i, q in labels.items() if i in got]
    assert len(both) > 50 and auc(np.array([s for s, _ in both]), np.array([q for _, q in both])) > 0.9


def classes(rows, percent=80):
    """Of every row its set, and of every set the number of its component, by all pairs."""
    sets = []
    for _, t in rows:
        w = [x.decode() for x in common.words_of(t)]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    kinds = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    part = {s: k for k, s in enumerate(kinds)}
    links = 0
    for a, s in enumerate(kinds):
        for t in kinds[a + 1 :]:
            if 100 * len(s & t) >= percent * len(s | t):
                links += 1
                old, new = max(part[s], part[t]), min(part[s], part[t])
                if old != new:
                    part = {k: new if v == old else v for k, v in part.items()}
    return sets, part, links


def test_op9(spark, folder, rows):
    sets, part, links = classes(rows)
    assert links > 100
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[part[s]] = min(i, least.get(part[s], i))
    expected = Counter((i, len(s), least.get(part[s]) if s else i) for (i, _), s in zip(rows, sets))
    got = run(spark, "op9_count_rtree_join", folder)
    assert got.dtypes[:3] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    made = got.collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in made) == expected
    assert len({r["component"] for r in made if r["component"] is not None}) == len(set(part.values()))


@pytest.mark.parametrize("seed", range(1))
def test_links_near_the_threshold(spark, seed):
    """Pairs of all sizes just above and below the threshold, in short and long sets, with shared passages and blocks of few
    members: no link is lost and none is made up."""
    r = random.Random(seed)
    passage, rows = " ".join(f"p{k}" for k in range(30)), []
    for n in (5, 6, 8, 9, 12, 17, 25, 31, 33, 40, 63, 64, 65, 100, 127, 129, 200, 260, 520):
        words = [f"w{r.randrange(10**9)}" for _ in range(n)]
        rows.append(" ".join(words))
        for _ in range(9):
            other = list(words)
            for _ in range(r.randint(0, max(1, n // 30))):
                k = r.randrange(len(other))
                other[k : k + 1] = r.choice([["e" + str(r.randrange(10**9))], [], [other[k], "e" + str(r.randrange(10**9))]])
            cut = r.randint(0, n // 5)
            rows.append(" ".join(r.choice([other, other[: len(other) - cut], other + [f"x{r.randrange(10**9)}" for _ in range(cut)]])))
        rows.append(" ".join(words[: n // 2]) + " " + passage)
    rows = [(k, t) for k, t in enumerate(rows)]
    sets, part, links = classes(rows)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s:
            least[part[s]] = min(i, least.get(part[s], i))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), most=4).collect()}
    assert links > 60 and got == {i: least[part[s]] if s else i for (i, _), s in zip(rows, sets)}


def test_units_meet():
    """Linked sets share a unit in every size class, whatever the order of their shingles' commonness."""
    r = np.random.default_rng(1)
    for _ in range(600):
        n = int(r.integers(4, 900))
        found = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        gone = int(r.integers(0, n // 5 + 1))
        kept = found[np.sort(r.permutation(n)[: n - gone])]
        new = r.integers(0, 1 << 63, int(r.integers(0, max(1, n // 4))), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        other = np.sort(np.concatenate([kept, new]))
        both = len(kept)
        if 100 * both >= 80 * (len(found) + len(other) - both) and (len(new) or gone):
            level = lambda s: ((s >> np.uint64(7)) % np.uint64(5)).astype(np.uint8)
            assert len(np.intersect1d(jaccard_join.units(found, level(found), 80), jaccard_join.units(other, level(other), 80)))


def test_op10_in_sql(spark, folder):
    got = run(spark, "op10_divergence", folder)
    assert got.dtypes[:8] == [("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet' where lang in ('en', 'fr') and doc_id is not null and doc_id <> 6 and doc_id <> 60")
    own = spark.read.parquet(f"{folder}/documents.parquet").where("lang in ('en', 'fr') and doc_id is not null and doc_id <> 6 and doc_id <> 60")
    made = quality_rules.measure(own, keep=["doc_id"]).drop("char_distance", "word_distance")
    cur = con.execute(registry.ORACLES["op10_divergence"])
    names = [c[0] for c in cur.description]
    assert sorted(repr([r[c] for c in made.columns]) for r in made.collect()) == sorted(repr([dict(zip(names, row))[c] for c in made.columns]) for row in cur.fetchall())


def test_distances_against_plain_sums(spark):
    rows = [(k, prose(60 + k) + " the of and" * (k % 4), ["en", "es", None, "xx"][k % 4]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.measure(docs).collect()}
    lists = {k: v.split() for k, v in quality_rules.COMMON_WORDS.items()}
    import re

    def measured(t, lang):
        left, chars = t, []
        for k, p in enumerate(quality_rules.CLASSES):
            rest = re.sub(p, "", left)
            if k != quality_rules.DIGITS:
                chars.append(len(left) - len(rest))
            left = rest
        toks = re.split("[.,;:!?]*[\x20\x09-\x0d]+", t.lower())
        if lang not in lists:
            hits = {k: sum(w in v for w in toks) for k, v in lists.items()}
            lang = min((k for k in hits if hits[k] == max(hits.values())), default=None) if max(hits.values()) else None
        common_ = [sum(w == x for w in toks) for x in lists[lang]] if lang else None
        return lang, [*chars, len(left)], common_, len(toks)

    def distance(a, b):
        p, q = np.array(a) / sum(a), np.array(b) / sum(b)
        m = (p + q) / 2
        part = lambda x: sum(v * math.log2(v / w) for v, w in zip(x, m) if v > 0)
        return math.sqrt(max(0.0, (part(p) + part(q)) / 2))

    found = {k: measured(t, g) for k, t, g in rows}
    for k, (lang, chars, words, n) in found.items():
        of = [f for f in found.values() if f[0] == lang]
        if lang is None:
            continue
        ref_c = np.sum([f[1] for f in of], axis=0)
        ref_w = np.sum([f[2] for f in of], axis=0)
        total = sum(f[3] for f in of)
        if sum(chars) >= 200:
            assert math.isclose(got[k]["char_distance"], distance(chars, ref_c), abs_tol=1e-9)
        assert math.isclose(got[k]["word_distance"], distance([*words, n - sum(words)], [*ref_w, total - ref_w.sum()]), abs_tol=1e-9)


def test_pipeline_by_plain_stages(spark, folder, rows):
    labels = {i: i % 3 and 1 for i, _ in rows if i is not None}
    learn = sorted((boosted_trees.statistics(t), float(labels[i])) for i, t in rows if i is not None)
    forest = boosted_trees.fit(np.array([a for a, _ in learn]), np.array([b for _, b in learn]))
    langs = [["en", "fr", "xx", None][k % 4] for k in range(len(rows))]
    kept = [(i, t, g) for (i, t), g in zip(rows, langs) if forest.score(np.array([boosted_trees.statistics(t)]))[0] >= 0.3]
    assert 10 < len(kept) < len(rows)
    docs = spark.createDataFrame(kept, "doc_id long, text string, lang string")
    good = Counter((r["doc_id"], r["text"]) for r in quality_rules.measure(docs).where("kept").collect())
    left = [x for x, n in good.items() for _ in range(n)]
    sets, part, _ = classes(left)
    best = {}
    for (i, t), s in zip(left, sets):
        if s:
            best.setdefault(part[s], []).append((i is None, i or 0, t))
    survivors = {p: min(v)[:2] for p, v in best.items()}
    packed = corpus_pipeline.run(spark, folder)
    got = Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in packed.where("piece = 0").collect())
    assert got == Counter(survivors.values())


def test_pipeline_keeps_different_texts_of_one_id(spark):
    a, b = prose(80), prose(80)
    rows = [(1, edited(a, 0) + " end", "en", "s", 1), (5, b, "en", "s", 2), (5, a, "en", "s", 3), (9, b + " tail", "en", "s", 4), (None, b + " other tail", "en", "s", 5), (7, None, "en", "s", 6), (7, None, "en", "s", 6), (8, " ", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["n_chars"]) for r in kept.collect()) == [(1, 1), (5, 2), (7, 6), (7, 6), (8, 7)]


def test_decoding_lists(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = prefix_bpe.read_ranks(path)
    a, b = ranks[b"a"], ranks[b" the"]
    rows = [(1, [a, b, a]), (2, None), (3, []), (4, [b] * 3000), (1, [a])]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(2)
    got = Counter((r["doc_id"], None if r["decoded"] is None else bytes(r["decoded"])) for r in prefix_bpe.decode_documents(docs, path).collect())
    assert got == Counter([(1, b"a thea"), (2, None), (3, b""), (4, b" the" * 3000), (1, b"a")])
    for bad in (-1, len(ranks) + 5):
        with pytest.raises(Exception, match="outside the vocabulary"):
            prefix_bpe.decode_documents(spark.createDataFrame([(1, [a, bad])], "doc_id long, ids array<int>"), path).collect()


def test_hot_ids_are_spread_in_order(spark):
    from marketlens.llm.ordered import LOWEST, dealt_by, parts_by_id

    rows = [(None, f"n{k}") for k in range(400)] + [(k, f"t{k}") for k in range(500)] + [(77, f"s{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    placed, n = parts_by_id(docs, "id", 8, "text")
    held = {}
    for r in dealt_by(placed, n).select("part", "key", "text", F.spark_partition_id().alias("at")).collect():
        assert r["part"] == r["at"] < n
        held.setdefault(r["part"], []).append((r["key"], r["text"]))
    assert sum(map(len, held.values())) == len(rows) and max(map(len, held.values())) < 300
    parts = [held[k] for k in sorted(held)]
    assert all(max(a)[0] <= min(b)[0] for a, b in zip(parts, parts[1:]))
    assert sum(any(k == LOWEST for k, _ in p) for p in parts) > 1
    whole, one = parts_by_id(docs, "id", 8)
    assert whole.where("id is null").select("part").distinct().count() == 1 and one <= 8
    got = range_coder.read_files(range_coder.write_files(docs.withColumnRenamed("id", "doc_id"), public_tokenizers.path("byte_bpe_50k.json"))).orderBy("start").collect()
    ids = [LOWEST if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]


def test_fingerprints_of_a_hot_id_are_spread(spark):
    from marketlens.llm import bloom_lookup
    from marketlens.llm.ordered import LOWEST, dealt_by, parts_by_id

    rows = [(7, f"line {k}\nshared\n" * (k % 3 + 1)) for k in range(400)] + [(k, f"t{k}\nshared") for k in range(200)] + [(7, "same")] * 30 + [(None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    placed, n = parts_by_id(docs.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", 6, "text")
    held = dealt_by(placed, n).collect()
    most = Counter(r["part"] for r in held if r["doc_id"] == 7)
    assert len(most) > 1 and max(most.values()) < 400 and n < 40
    order = sorted(((r["key"], r["tie"], r["text"], r["part"]) for r in held))
    assert [r[3] for r in order] == sorted(r[3] for r in order)
    following = [*order[1:], order[0]]
    expected = Counter((None if a[0] == LOWEST else a[0], bloom_lookup.edit_of(a[2], b[2]), round(bloom_lookup.likeness(bloom_lookup.digests(a[2]), bloom_lookup.digests(b[2])), 12)) for a, b in zip(order, following, strict=True))
    got = Counter((r["doc_id"], r["edited"], round(r["near_next"], 12)) for r in bloom_lookup.fingerprint_versions(docs).collect())
    assert got == expected


def test_the_plan_of_parts_does_not_grow_with_them(spark):
    from marketlens.llm.ordered import parts_by_id

    docs = spark.range(20_000).select(F.col("id"), F.col("id").cast("string").alias("text"))
    plans = [parts_by_id(docs, "id", k, "text")[0]._jdf.queryExecution().analyzed().toString() for k in (4, 400)]
    assert len(plans[1]) < 1.2 * len(plans[0])
