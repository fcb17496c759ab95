"""Queries over whole texts and whole query sets, against brute force in Python."""

import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import retrieval
from marketlens.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def slots_of(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    return [int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 128 for w in words]


def test_hash_embedding_reads_whole_texts(spark, tmp_path):
    texts = {1: "river " * 50 + "stone cloud letter", 2: "1234567890" * 30 + " winter", 3: None, 4: "", 5: "99 !", 6: "garden", 7: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x" for k in range(20_000))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["slots"] for r in catalog.hash_embedding(spark, str(tmp_path)).collect()}
    assert got == {k: ",".join(map(str, sorted(set(slots_of(t))))) for k, t in texts.items() if slots_of(t)}
    for r in docs.select("doc_id", retrieval.embed_hashed(F.col("text")).alias("e")).collect():
        raw = np.bincount(np.array(slots_of(texts[r["doc_id"]]), int), minlength=128).astype(float)
        assert np.allclose(r["e"], raw / (np.linalg.norm(raw) or 1.0))


@pytest.fixture(scope="module")
def found(spark):
    """For every query its whole ranking (vec_id, label, similarity), and every query's label, by brute force."""
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    e = np.array([r["embedding"] for r in rows], float)
    cos = np.round(e @ e.T / np.sqrt((e * e).sum(axis=1)[:, None] * (e * e).sum(axis=1)), 6)
    out = {}
    for k, q in enumerate(rows):
        if q["vec_id"] % 20 == 0:
            out[q["vec_id"]] = q["label"], sorted((-cos[k, n], r["vec_id"], r["label"]) for n, r in enumerate(rows) if r["vec_id"] != q["vec_id"])
    return out


needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@needs_tables
def test_search_takes_every_twentieth_vector(spark, found):
    expected = {(q, v, ql, lv, -s, k + 1) for q, (ql, r) in found.items() for k, (s, v, lv) in enumerate(r[:5])}
    assert len(found) == 25
    columns = ("query_id", "vec_id", "query_label", "label", "similarity", "rank")
    assert {tuple(r[c] for c in columns) for r in catalog.vector_topk_each(spark, FOLDER).collect()} == expected
    v, q = spark.read.parquet(f"{FOLDER}/embeddings.parquet"), catalog._query_set(spark, FOLDER)
    assert {tuple(r[c] for c in columns) for r in retrieval.top_k_each(v, q, 5, block=(4, 60)).collect()} == expected


@needs_tables
def test_metrics_of_every_query(spark, found):
    got = {r["query_id"]: r for r in catalog.retrieval_metrics(spark, FOLDER).collect()}
    bounds = {r["query_id"]: r for r in catalog.precision_bounds(spark, FOLDER).collect()}
    pairs = catalog.paired_outcomes(spark, FOLDER).first()
    assert got.keys() == bounds.keys() == found.keys()
    deltas = []
    for q, (label, ranked) in found.items():
        hits = [lv == label for _, _, lv in ranked[:5]]
        n = sum(lv == label for _, _, lv in ranked)
        ideal = sum(1 / np.log2(k + 2) for k in range(min(n, 5)))
        first = next((1 / (k + 1) for k, h in enumerate(hits) if h), 0.0)
        r = got[q]
        assert np.allclose((r["precision"], r["recall"], r["hit"], r["reciprocal_rank"], r["ndcg"]), (sum(hits) / 5, sum(hits) / n, any(hits), first, sum(h / np.log2(k + 2) for k, h in enumerate(hits)) / ideal))
        judged = [(v + q) % 3 != 0 for _, v, _ in ranked[:5]]
        low = sum(h and j for h, j in zip(hits, judged))
        assert np.allclose((bounds[q]["lower"], bounds[q]["upper"], bounds[q]["coverage"]), (low / 5, (low + 5 - sum(judged)) / 5, sum(judged) / 5))
        deltas.append(sum(hits) / 5 - hits[0])
    assert (pairs["wins"], pairs["ties"], pairs["losses"]) == (sum(x > 0 for x in deltas), sum(x == 0 for x in deltas), sum(x < 0 for x in deltas))
    assert np.isclose(pairs["mean_difference"], np.mean(deltas))


@needs_tables
def test_themes_are_queries_in_order(spark, found):
    taken, expected = set(), set()
    for place, q in enumerate(sorted(found)[:3]):
        for s, v, _ in sorted(((s, str(v), lv) for s, v, lv in found[q][1][:5]))[:2]:
            if v not in taken:
                expected.add((v, q, place + 1, -s))
            taken.add(v)
    assert {(r["document_id"], r["theme"], r["theme_rank"], r["similarity"]) for r in catalog.retrieve_per_theme(spark, FOLDER).collect()} == expected


def test_search_of_null_and_zero_vectors(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 1.0]), (2, 2, None), (3, 2, [0.0, 0.0]), (None, 2, [1.0, 0.0]), (4, 1, [2.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    q = v.where("vec_id = 0").selectExpr("vec_id as query_id", "label as query_label", "embedding as query")
    got = [(r["vec_id"], r["similarity"], r["rank"]) for r in retrieval.top_k_each(v, q, 3).orderBy("rank").collect()]
    assert got == [(1, 0.707107, 1), (4, 0.707107, 2), (2, None, 3)]
    assert retrieval.top_k_each(v, q.where("false"), 3).count() == 0 and retrieval.top_k_each(v.where("false"), q, 3).count() == 0
